"""Toxicity: a classifier over words and their beginnings, penalised when swapping identity terms changes its scores."""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import fold, map_texts
from terrafold.plans.session import bounded_broadcast, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The model is fitted on a bounded sample of labelled rows and a bounded number of words.
TRAIN_ROWS = 20_000
MAX_WORDS = 4_096
MIN_DOCS = 5
# A feature enters when its log-likelihood ratio is above this; 15 is a chance of about 1e-4 per feature.
MIN_RATIO = 15.0
SWAP_PENALTY = 20.0
RIDGE = 1e-4
# Toxic rows weigh (clean / toxic) ** BALANCE more: 0 keeps the shares of the sample, 1 makes the classes equal.
BALANCE = 0.5
# Lengths of word beginnings that are features of their own, so that an unseen form of a known stem counts.
STEMS = (3, 4, 5, 6)
STEPS = 600
WEIGHT_UNIT = 1_000_000

# Terms of one line name groups of people in the same role; a swap takes the next term of the line.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("black", "white", "asian", "latino"), ("african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("disabled", "blind", "deaf"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "inländer"), ("schwul", "lesbisch"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulman", "chrétien", "juif"), ("étranger", "citoyen"), ("noir", "blanc"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmán", "cristiano", "judío"), ("extranjero", "ciudadano"), ("negro", "blanco"),
)

_WORD = re.compile(r"[^\W\d_]+")
_TERMS = frozenset(t for line in IDENTITY_TERMS for t in line)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(text: str | None, terms: frozenset[str] = _TERMS) -> set[str]:
    """Words, and the beginnings of words as ``begin*``. An identity term is one feature only, so a swap of terms
    changes nothing but these."""
    words = words_of(text)
    longer = words - terms
    return words.union(*[{w[:n] + "*" for w in longer if len(w) >= n} for n in STEMS])


def copy_mark(text: str | None) -> int:
    """The smallest hash of the text's word triples: near copies mostly agree on it."""
    import xxhash

    tokens = _WORD.findall((text or "").lower())
    triples = zip(tokens, tokens[1:], tokens[2:]) if len(tokens) > 2 else [tuple(tokens)]
    return min(xxhash.xxh64_intdigest(" ".join(t)) for t in triples) >> 1


@dataclass(frozen=True)
class ToxicityModel:
    words: tuple[str, ...]  # and beginnings of words, which end in *
    weights: tuple[float, ...]
    bias: float
    terms: frozenset[str] = _TERMS

    def scorer(self):
        weight, bias, terms = dict(zip(self.words, self.weights)), self.bias, self.terms
        heads = {w[: STEMS[0]] for w in weight if w.endswith("*")}
        stems = {n: {w[:-1] for w in weight if w.endswith("*") and len(w) == n + 1} for n in STEMS}

        def known(text: str | None) -> set[str]:
            words = words_of(text)
            found = {w for w in words if w in weight}
            for w in words:
                if w[: STEMS[0]] in heads and w not in terms:
                    found.update(w[:n] + "*" for n, some in stems.items() if w[:n] in some)
            return found

        def score(texts: list[str | None]) -> list[list]:
            sums = [bias + math.fsum(weight[w] for w in known(t)) for t in texts]
            scores = [1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, s)))) for s in sums]
            return [scores, [int(s >= 0.5) for s in scores]]

        return score


def _sample(docs: DataFrame, labels: DataFrame, rows: int, terms: frozenset[str]) -> DataFrame:
    """At most ``rows`` labelled texts outside fold 0, drawn by hash, with their features and weights.

    A row is one doc_id with one text: rows that repeat both are one, and the bound holds for the rows, not the ids."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    marked = written(marked, "toxic_labels")
    n = marked.count()
    drawn = _drawn(marked, n, rows, "doc_id")
    found = docs.select("doc_id", "text").join(bounded_broadcast(drawn, min(n, rows)), "doc_id")
    texts = written(found.groupBy("doc_id", F.xxhash64("text").alias("copy")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")), "toxic_texts")
    texts = _drawn(texts, texts.count(), rows, "doc_id", "copy").drop("copy")

    def start():
        return lambda texts: [[sorted(features_of(t, terms)) for t in texts], [copy_mark(t) for t in texts]]

    sample = written(map_texts(texts, start, "words array<string>, mark bigint"), "toxic_sample")
    sizes = sample.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"))
    weight = (F.lit(WEIGHT_UNIT) / F.col("copies")).cast("bigint")
    return written(sample.join(bounded_broadcast(sizes, rows), "mark").withColumn("weight", weight), "toxic_weighted")


def _drawn(df: DataFrame, n: int, rows: int, *by: str) -> DataFrame:
    """All of ``n`` rows, or at most ``rows`` of them by a hash of ``by``."""
    if n <= rows:
        return df
    # drawn a little below the bound, so that chance hardly ever exceeds it; the limit holds it in any case
    rate = max(0.0, rows - 4 * math.sqrt(rows)) / n
    draw = F.pmod(F.xxhash64(F.lit(3), *by), F.lit(1_000_000))
    return df.filter(draw < rate * 1_000_000).limit(rows)


def _ratio(a, b, all_a, all_b):
    """Log-likelihood ratio of a word's counts in two classes."""
    share = (a + b) / F.lit(all_a + all_b)
    part = lambda x, whole: F.when(x > 0, x * F.log(x / (whole * share))).otherwise(0.0)
    rest = lambda x, whole: F.when(whole - x > 0, (whole - x) * F.log((whole - x) / (whole * (1 - share)))).otherwise(0.0)
    return 2 * (part(a, F.lit(all_a)) + part(b, F.lit(all_b)) + rest(a, F.lit(all_a)) + rest(b, F.lit(all_b)))


def _choose_words(sample: DataFrame, max_words: int, min_docs: int, min_ratio: float) -> list[str]:
    unit = F.lit(float(WEIGHT_UNIT))
    w, hit = F.col("weight"), F.col("toxic") == 1
    sums = sample.agg(F.sum(F.when(hit, w)).alias("a"), F.sum(F.when(~hit, w)).alias("b")).first()
    all_a, all_b = (sums["a"] or 0) / WEIGHT_UNIT, (sums["b"] or 0) / WEIGHT_UNIT
    if not all_a or not all_b:
        return []
    counts = (
        sample.select("toxic", "weight", F.explode("words").alias("word"))
        .groupBy("word")
        .agg((F.sum(F.when(hit, w).otherwise(0)) / unit).alias("a"), (F.sum(F.when(~hit, w).otherwise(0)) / unit).alias("b"))
        .filter(F.col("a") + F.col("b") >= min_docs)
        .withColumn("ratio", _ratio(F.col("a"), F.col("b"), all_a, all_b))
        .filter(F.col("ratio") >= min_ratio)
    )
    return [r["word"] for r in counts.orderBy(F.col("ratio").desc(), "word").limit(max_words).select("word").collect()]


def fit_weights(rows: list[list[int]], toxic, weight, swaps: dict[int, int], size: int, penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = STEPS):
    """(weights, bias) of a logistic model over present words, by gradient steps with momentum.

    Loss: weighted log loss + ridge + ``penalty`` times the mean squared change of the raw score when the
    identity terms of a sentence are swapped."""
    y, g = np.asarray(toxic, dtype=float), np.asarray(weight, dtype=float)
    g = g / max(g.sum(), 1e-12)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.array([i for r in rows for i in r], dtype=np.int64)
    pairs = [(n, i, swaps[i]) for n, r in enumerate(rows) for i in r if i in swaps]
    swapped = sorted({n for n, _, _ in pairs})
    place = {n: k for k, n in enumerate(swapped)}
    who = np.array([place[n] for n, _, _ in pairs], dtype=np.int64)
    old, new = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (1, 2))
    share = np.array([g[n] for n in swapped])
    share = share / max(share.sum(), 1e-12)
    w, bias, m, v = np.zeros(size), math.log((y @ g + 1e-3) / (1 - y @ g + 1e-3)), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(owner, w[index], minlength=len(rows))
        error = g * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(index, error[owner], minlength=size) + ridge * w
        if len(pairs):
            change = np.bincount(who, w[new] - w[old], minlength=len(swapped)) * share * 2 * penalty
            grad += np.bincount(new, change[who], minlength=size) - np.bincount(old, change[who], minlength=size)
        full = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS,
        min_ratio: float = MIN_RATIO, penalty: float = SWAP_PENALTY, identity_terms=IDENTITY_TERMS, balance: float = BALANCE) -> ToxicityModel:
    """Fit on labelled rows outside fold 0 (crc32 of the id modulo 5); never on more than ``train_rows``.

    Candidate features are chosen by Spark from all features of the sample; near copies share one row's weight, so
    a large group of copies adds none of its own. Several labels of a document count as toxic if one is.
    The rarer class weighs more in the fit, by ``balance``.
    Without labelled rows the model knows no word and its score is 0.
    """
    terms = frozenset(t for line in identity_terms for t in line)
    sample = _sample(docs, labels, train_rows, terms)
    if not sample.limit(1).count():
        return ToxicityModel((), (), -500.0)
    vocabulary = sorted(terms | set(_choose_words(sample, max_words, min_docs, min_ratio)))
    number = {w: i for i, w in enumerate(vocabulary)}
    swaps = {number[a]: number[b] for line in identity_terms for a, b in zip(line, (*line[1:], line[0]))}
    # the bounded sample, reduced to known features
    known = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    rows = sample.select("doc_id", "toxic", "weight", known.alias("words")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["words"]))
    hits, misses = (sum(r["weight"] for r in rows if bool(r["toxic"]) == kind) for kind in (True, False))
    lift = (misses / hits) ** balance if hits and misses else 1.0
    weight = [r["weight"] * (lift if r["toxic"] else 1.0) for r in rows]
    weights, bias = fit_weights([[number[w] for w in sorted(r["words"])] for r in rows], [r["toxic"] for r in rows], weight, swaps, len(vocabulary), penalty)
    return ToxicityModel(tuple(vocabulary), tuple(float(w) for w in weights), bias, terms)


def score_toxicity(docs: DataFrame, model: ToxicityModel, drop_text: bool = True) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= 0.5). Only the text decides; null is empty, and
    an empty text gets the score of a text without any known feature. Own names replace equal columns."""
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    return map_texts(docs.drop(*clash), model.scorer, "score double, predicted int", drop_text)
