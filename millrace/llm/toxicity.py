"""A toxicity classifier that is made indifferent to which group a text mentions.

Logistic regression on the presence of words. Beside the labels it is fitted on counterfactuals:
every labelled text with an identity term is copied with the term swapped for each of the others,
and the squared change of the score's logit is penalised. So a group that is often named in toxic
texts doesn't make a neutral mention toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

#: Labelled rows that a fit takes at most, dealt by a hash of their keys. The bound holds in the mean.
SAMPLE = 20_000
#: A word's log-likelihood ratio against the label must reach this (chance: one in 10,000 words or fewer).
LEAST_RATIO = 16.0
#: Weight of the squared coefficients, and of squared changes of the logit under a swap.
RIDGE, SWAP = 0.05, 10.0
#: A score from here on is toxic.
THRESHOLD = 0.7
#: Terms that are swapped for one another, in English, French, Spanish and German.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender", "nonbinary"],
    ["gay", "lesbian", "bisexual", "straight", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european", "american"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "deaf", "blind", "autistic"],
    ["old", "young", "elderly"],
    ["femmes", "hommes", "filles", "garçons"],
    ["femme", "homme", "fille", "garçon"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["homosexuel", "lesbienne", "bisexuel", "hétérosexuel"],
    ["noirs", "blancs", "asiatiques", "arabes", "européens"],
    ["immigrés", "réfugiés", "étrangers"],
    ["handicapé", "sourd", "aveugle"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["mujer", "hombre", "niña", "niño"],
    ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo"],
    ["musulmanes", "cristianos", "judíos", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos", "árabes", "europeos"],
    ["inmigrantes", "refugiados", "extranjeros"],
    ["discapacitado", "sordo", "ciego"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["frau", "mann"],
    ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    ["schwul", "lesbisch", "bisexuell", "heterosexuell"],
    ["schwarze", "weiße", "asiaten", "araber", "europäer"],
    ["einwanderer", "flüchtlinge", "ausländer"],
    ["behindert", "gehörlos", "blinde"],
]


def _hashes(terms: list[str]) -> np.ndarray:
    return np.array([W.words(pa.array([t]), W.ALNUM).hash[0] for t in terms], np.uint64)


def word_sets(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, and the row of each."""
    found = W.words(batch[text], W.ALNUM)
    row = np.repeat(np.arange(len(batch)), found.count)
    both = np.unique(np.stack([row.astype(np.uint64), found.hash], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
    return both[:, 1], both[:, 0].astype(np.int64)


@dataclass
class Model:
    """Hashes of words in ascending order, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, batch: pa.RecordBatch, text: str) -> np.ndarray:
        found = W.words(batch[text], W.ALNUM)
        z = np.full(len(batch), self.bias)
        if len(self.features) and len(found.hash):
            at = np.minimum(np.searchsorted(self.features, found.hash), len(self.features) - 1)
            hit = np.flatnonzero(self.features[at] == found.hash)
            row = np.searchsorted(found.first, hit, "right") - 1
            both = np.unique(row * len(self.features) + at[hit])
            z += np.bincount(both // len(self.features), self.weights[both % len(self.features)], minlength=len(batch))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Swaps:
    """The Gram matrix of the feature changes of all counterfactuals. Only identity terms change, so it has rows for these alone."""

    def __init__(self, rows: list[np.ndarray], times: np.ndarray, groups: list[list[int]]) -> None:
        """``rows``: the features of each kind of text; ``times``: how many there are of it; ``groups``: features that are swapped for one another."""
        self.terms = np.array(sorted({t for g in groups for t in g}), np.int64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        self.gram = np.zeros((len(place), len(place)))
        for own, n in zip(rows, times):
            own = {place[t] for t in own.tolist() if t in place}
            for group in [[place[t] for t in g] for g in groups] if own else []:
                for i in own.intersection(group):
                    for j in group:
                        if j != i:
                            d = {i: 1.0} if j in own else {i: 1.0, j: -1.0}
                            for a, u in d.items():
                                for b, v in d.items():
                                    self.gram[a, b] += n * u * v

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w))
        if len(self.terms):
            out[self.terms] = self.gram @ w[self.terms]
        return out

    def diagonal(self, k: int) -> np.ndarray:
        out = np.zeros(k)
        if len(self.terms):
            out[self.terms] = np.diag(self.gram)
        return out


def newton(rows: list[np.ndarray], k: int, y: np.ndarray, times: np.ndarray, swaps: Swaps, ridge: float = RIDGE, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights of ``k`` features and bias that minimise log loss + ridge + ``swap`` times the squared changes of the logit.

    Row ``i`` has the features ``rows[i]`` and counts ``times[i]`` times. Newton's method with step halving; each step is
    solved by conjugate gradients, so nothing of the size of the features' square is made.
    """
    n = len(rows)
    of, at = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    own = np.append(np.full(k, ridge), 1e-6)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(of, w[at], minlength=n) + w[k]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, u[of], minlength=k), u.sum())

    def penalty(w: np.ndarray) -> np.ndarray:
        return own * w + swap * swaps.times(w)

    def loss(w: np.ndarray) -> float:
        z = forward(w)
        return float(times @ (np.logaddexp(0, z) - y * z) + w @ penalty(w) / 2)

    w = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -500, 500)))
        spread, slope = times * p * (1 - p), back(times * (p - y)) + penalty(w)
        scale = back(spread) + own + swap * swaps.diagonal(k + 1) + 1e-9
        step, left = np.zeros(k + 1), slope.copy()
        ahead = left / scale
        size = left @ ahead
        for _ in range(2 * (k + 1)):
            if np.abs(left).max() < 1e-8 * max(1.0, np.abs(slope).max()):
                break
            curved = back(spread * forward(ahead)) + penalty(ahead)
            pace = size / (ahead @ curved)
            step, left = step + pace * ahead, left - pace * curved
            scaled = left / scale
            size, before = left @ scaled, size
            ahead = scaled + size / before * ahead
        much, now = 1.0, loss(w)
        while loss(w - much * step) > now and much > 1e-6:
            much /= 2
        w = w - much * step
        if np.abs(much * step).max() < 1e-5:
            break
    return w[:k], float(w[k])


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows in the mean, or all if there are fewer; a key is in or out by its hash."""
    share = min(1.0, n / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(labelled: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, identity: list[list[str]] | None = None, swap: float = SWAP) -> Model:
    """Fit on ``labelled``; rows with a null label or key are left out, a null text is an empty one.

    At most about ``sample`` rows, dealt by a hash of the key, are used, with all words of theirs that reach ``LEAST_RATIO``, each of
    which has a weight of its own, as has each identity term; ties among words decide nothing. What the driver gets is bounded by the
    distinct words of the sample. Without rows of both labels every score
    is that of the labels there are.
    """
    rows = sampled(labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()), key, sample)
    rows = rows.select(F.col(label).cast("int").alias("y"), F.col(text).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            h, row = word_sets(batch, "text")
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch["y"].take(pa.array(row))], names=["h", "y"])

    n = dict.fromkeys((0, 1), 0) | {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if n[0] == n[1] else 6.0 if n[1] else -6.0)
    counts = rows.mapInArrow(extract, "h bigint, y int").groupBy("h").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    g = F.lit(0.0)
    for seen, of in (("p", n[1]), ("q", n[0])):
        expected = (F.col("p") + F.col("q")) * (of / (n[0] + n[1]))
        g = g + F.when(F.col(seen) > 0, 2 * F.col(seen) * F.ln(F.col(seen) / expected)).otherwise(0.0)
        away, mean = of - F.col(seen), F.lit(float(of)) - expected
        g = g + F.when(away > 0, 2 * away * F.ln(away / mean)).otherwise(0.0)
    best = counts.withColumn("g", g).where((F.col("g") >= LEAST_RATIO) & (F.col("p") + F.col("q") >= 3)).select("h")
    best = np.array([r.h for r in best.collect()], np.int64).view(np.uint64)
    terms = [_hashes(group) for group in (IDENTITY if identity is None else identity)]
    features = np.unique(np.concatenate([best, *terms])).astype(np.uint64)
    k = len(features)
    groups = [list(dict.fromkeys(np.searchsorted(features, t).tolist())) for t in terms]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            h, row = word_sets(batch, "text")
            at = np.minimum(np.searchsorted(features, h), k - 1)
            ok = features[at] == h
            both = np.unique(row[ok] * k + at[ok])
            cut = np.searchsorted(both // k, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["y"], pa.ListArray.from_arrays(pa.array(cut), pa.array((both % k).astype(np.int32)))], names=["y", "at"])

    # Texts of equal label and features count once, with their number: the driver gets patterns, not texts.
    table = rows.mapInArrow(hits, "y int, at array<int>").groupBy("y", "at").agg(F.count("*").alias("n")).collect()
    found, times = [np.array(r.at, np.int64) for r in table], np.array([r.n for r in table], float)
    weights, bias = newton(found, k, np.array([r.y for r in table], float), times, Swaps(found, times, groups), swap=swap)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, score)``, one per row of ``docs``. A null text is an empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.score(batch, "text"), pa.float64())], names=["id", "score"])

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("id", key)


def held_out(key) -> F.Column:
    """One key in three, by crc32 of its text, is kept from the fit."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the labels of ``docs`` that are not held out.

    A key with several labels counts with its highest, one with several texts with the last in order of bytes. The sample is drawn from the
    labels, so that about ``sample`` keys are broadcast and no texts are shuffled but theirs.
    """
    own = labels.where(~held_out(key) & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    own = sampled(own, key, sample)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(own), key).groupBy(key).agg(F.max("_text").alias("_text"), F.max("_label").alias("_label"))
    return fit(Scratch(docs.sparkSession, "toxicity").table(rows, "labelled"), key, "_text", "_label", sample)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(key, held_out, score, predicted)``, one per row of ``docs``. Null keys are not held out."""
    found = score(docs, fit_on(docs, labels, key, text), key, text)
    return found.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
