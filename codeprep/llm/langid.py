"""Operator 1: language identification by Kneser-Ney character models.

For each language an interpolated Kneser-Ney model of ``ORDER`` characters is
learned from a bounded sample (``TRAIN_ROWS`` documents a language at most,
chosen by a hash of the id).  The n-grams of all languages stand in one
sorted array of 64-bit hashes an order, beside a matrix of their
probabilities; a text is looked up by binary search, one numpy step for many
texts.  The language of the least cross-entropy per character wins, the first
of equals in alphabetical order.  Documents kept out of the counts calibrate
the score (a temperature of the posterior) and a limit of the entropy above
which a text is ``rejected`` (its prediction is still given).

Texts are lower-cased; all but letters counts as one space.  Null texts and
texts without a letter are ``und`` with score 0; so is every text if nothing
could be learned.  Rows with null language are scored, not learned from.
Texts of any length are read whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.common import codepoints, map_texts, mix, seg_sum, steps, written

ORDER, TRAIN_ROWS, CALIBRATION_ROWS, SHARED_LANGUAGES = 4, 600, 150, 256
UNDETERMINED = "und"
SPACE, LOW = 32, 0x3000


def _alpha_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(LOW)])


_ALPHA = _alpha_table()


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single spaces between words, ORDER - 1 spaces
    before each text and one after it; the limits of the texts in that array."""
    cp, limits = codepoints([" " * (ORDER - 1) + t.lower() + " " for t in texts])
    letter = _ALPHA[np.minimum(cp, LOW - 1)]
    far = np.flatnonzero(cp >= LOW)
    if len(far):
        kinds, at = np.unique(cp[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[at]
    cp = np.where(letter, cp, np.uint32(SPACE))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begin = limits[:-1]
    keep[begin] = True
    for i in range(1, ORDER - 1):
        keep[begin + i] = True
    keep[begin + ORDER - 1 - 1] = True
    after = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=after[1:])
    return cp[keep], after[limits]


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (from place n - 1 on)."""
    key = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        key = key * np.uint64(0x1_0000_01B3) + x[i:len(x) - n + 1 + i]
    return mix(key)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)     # order: hashes, log probability by language
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # order: hashes of n - 1, log weight of the lower order
    floor: np.ndarray | None = None  # log probability of a character never seen
    temperature: float = 1.0
    limit: np.ndarray | None = None  # of the entropy, by language

    def log_p(self, hashes: dict[int, np.ndarray], n: int, at: np.ndarray) -> np.ndarray:
        """Log probability, by language, of the character at each place ``at``."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        if n == 0:
            out[:] = self.floor
            return out
        keys, values = self.grams[n]
        place = np.minimum(np.searchsorted(keys, hashes[n][at]), len(keys) - 1)
        hit = keys[place] == hashes[n][at]
        out[hit] = values[place[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            low = self.log_p(hashes, n - 1, at[miss])
            if n > 1:
                keys, values = self.contexts[n]
                context = hashes[n - 1][at[miss] - 1]
                place = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                known = keys[place] == context
                low[known] += values[place[known]]
            out[miss] = low
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language; characters scored (0: no letter)."""
        x, limits = normal(texts)
        n = limits[1:] - limits[:-1] - (ORDER - 1)
        if not len(x):
            return np.zeros((len(texts), len(self.languages))), n
        hashes = {k: np.append(np.zeros(k - 1, np.uint64), gram_hashes(x, k)) for k in range(1, ORDER + 1)}
        sums = np.empty((len(texts), len(self.languages)))
        inside = np.ones(len(x), bool)
        for i in range(ORDER - 1):
            inside[limits[:-1] + i] = False
        at = np.flatnonzero(inside)
        lp = self.log_p(hashes, ORDER, at)
        ends = np.cumsum(n)
        for k in range(len(self.languages)):
            sums[:, k] = seg_sum(lp[:, k].astype(np.float64), ends - n, ends)
        letters = seg_sum((x != SPACE).astype(np.int64), limits[:-1], limits[1:])
        return -sums / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> dict[str, list]:
        best = entropy.argmin(1)
        z = -entropy * np.minimum(n, 300)[:, None] * self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        score = (z / z.sum(1, keepdims=True))[np.arange(len(n)), best]
        low = entropy[np.arange(len(n)), best]
        none = n == 0
        return {"lang_pred": [UNDETERMINED if x else self.languages[b] for b, x in zip(best.tolist(), none.tolist())],
                "score": np.where(none, 0.0, np.round(score, 6)),
                "entropy": np.where(none, 0.0, np.round(low, 6)),
                "rejected": none | (low > self.limit[best])}


def _kneser_ney(counts: dict[str, int], vocabulary: int) -> tuple[dict[int, dict[str, float]], dict[int, dict[str, float]], float]:
    """Of one language's n-grams of the highest order: by order, the
    interpolated probability of each n-gram seen and the weight that each
    context leaves to the order below; the probability of an unseen character."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # how many different characters come before
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p: dict[int, dict[str, float]] = {}
    weight: dict[int, dict[str, float]] = {}
    floor = 1.0 / vocabulary
    for n in range(1, ORDER + 1):
        level = levels[n]
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weight[n] = {h: discount * kinds[h] / total[h] for h in total}
        lower = p.get(n - 1, {})
        p[n] = {g: (c - discount) / total[g[:-1]] + weight[n][g[:-1]] * (lower[g[1:]] if n > 1 else floor) for g, c in level.items()}
    return p, weight, weight[1][""] * floor


def build(counts: dict[str, dict[str, int]]) -> Model:
    """The models of all languages, n-grams known to any of them side by side."""
    m = Model(sorted(counts))
    vocabulary = len({g[-1] for c in counts.values() for g in c}) + 1
    parts = [_kneser_ney(counts[x], vocabulary) for x in m.languages]
    m.floor = np.log(np.array([f for _, _, f in parts], np.float32))

    def hashed(strings: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(-1, n)
        key = np.full(len(flat), n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x1_0000_01B3) + flat[:, i]
        key = mix(key)
        order = np.argsort(key, kind="stable")
        return key[order], order

    for n in range(1, ORDER + 1):
        if n > 1:
            heads = sorted({h for _, w, _ in parts for h in w[n]})
            key, order = hashed(heads, n - 1)
            values = np.array([[w[n].get(h, 1.0) for _, w, _ in parts] for h in heads])[order]
            m.contexts[n] = key, np.log(values).astype(np.float32)

        def probability(g: str, p, w, floor, n=n) -> float:
            k, scale = n, 1.0
            while k and g[n - k:] not in p[k]:
                scale *= w[k].get(g[n - k:-1], 1.0) if k > 1 else 1.0
                k -= 1
            return scale * (p[k][g[n - k:]] if k else floor)

        grams = sorted({g for p, _, _ in parts for g in p[n]})
        key, order = hashed(grams, n)
        m.grams[n] = key, np.log(np.array([[probability(g, *x) for x in parts] for g in grams])[order]).astype(np.float32)
    return m


def _counted(rows: DataFrame) -> dict[str, dict[str, int]]:
    """n-grams of the highest order by language: bounded by the sample's characters."""
    def run(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs = batch.column(0).to_pylist()
            for a, b in steps(texts):
                x, limits = normal(texts[a:b])
                s = x.astype("<u4").tobytes().decode("utf-32-le")
                for lang, i, j in zip(langs[a:b], limits[:-1].tolist(), limits[1:].tolist()):
                    by.setdefault(lang, Counter()).update(s[k:k + ORDER] for k in range(i, j - ORDER + 1))
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for lang, gram, n in got.collect():
        if gram:
            out.setdefault(lang, {})[gram] = n
    return out


def learn(df: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS,
          calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Models of all languages of ``df``, from the ``train_rows`` documents of
    each with the least hashes of their ids; the next ``calibration_rows``
    calibrate.  Beyond SHARED_LANGUAGES languages these share that many
    languages' rows (five of each at least).  None if there is no language."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("at")).where("lang is not null and text is not null")
    common = written(rows.groupBy("lang").count(), "languages")
    part = min(1.0, SHARED_LANGUAGES / max(1, common.count()))
    train_rows, calibration_rows = max(4, int(train_rows * part)), max(1, int(calibration_rows * part))
    # a limit by the share of the hashes first, so that the window ranks about twice the sample alone
    share = F.least(F.lit(1.0), F.lit(2.0 * (train_rows + calibration_rows) + 100) / F.col("count"))
    some = rows.join(common, "lang").where(F.pmod("at", F.lit(1 << 40)) < share * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("at", F.lit(1 << 40)), "at", F.xxhash64("text")))
    picked = some.select("lang", "text", rank.alias("rank")).where(F.col("rank") <= train_rows + calibration_rows)
    fifth = F.col("rank") % 5 == 0  # every fifth calibrates
    counts = _counted(picked.where(~fifth))
    if not counts:
        return None
    m = build(counts)
    m.limit = np.full(len(m.languages), np.inf)
    sent = df.sparkSession.sparkContext.broadcast(m)

    def make():
        def run(texts):
            entropy, n = sent.value.entropies(texts)
            return {"h": list(entropy), "n": n}
        return run

    held = map_texts(picked.where(fifth & F.col("lang").isin(m.languages)), ["lang"], "text", make, "h array<double>, n bigint").where("n > 0").collect()
    if held:
        h, n = np.array([r["h"] for r in held]), np.array([r["n"] for r in held])
        truth = np.array([m.languages.index(r["lang"]) for r in held])

        def loss(t: float) -> float:
            z = -h * np.minimum(n, 300)[:, None] * t
            return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(n)), truth]).mean())

        m.temperature = min((2.0 ** -i for i in range(8)), key=loss)
        for k in range(len(m.languages)):
            own = h[(truth == k) & (n >= 20), k]
            if len(own) >= 20:
                m.limit[k] = own.mean() + 6 * own.std()
    return m


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1), entropy and rejected for each row's whole text."""
    if model is None:
        return df.select(key, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: sent.value.decide(*sent.value.entropies(texts))

    return map_texts(df, [key], text, make, "lang_pred string, score double, entropy double, rejected boolean")
