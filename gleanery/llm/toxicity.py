"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A sentence's probability is logistic in its distinct words and their beginnings. A document is toxic if any of its sentences is, or by a leak that belongs to no
sentence (what labels say without a reason in the text): P = 1 - (1 - leak) * product(1 - p), a noisy-or. Only documents have labels, so the
gradient of a sentence's logit is p for clean documents and -p (1 - P) / P for toxic ones: it goes to the sentences that most likely explain the label,
which are thereby located. An L1 penalty leaves few features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_name, small_batches

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")

#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7, 8)

#: A sentence of at least this probability is offending.
OFFENDING = 0.3


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between marks that are not blank, in code points."""
    return [m.span() for m in SENTENCE.finditer(text) if not m[0].isspace()]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings, which inflected and compounded forms share."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-z))


class Bags:
    """Documents as bags of sentences: sentences with known words as sets of their numbers, and how many there are besides."""

    def __init__(self, docs: Iterable[list[list[int]]]):
        ids, lens, counts, rest = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], []
        for d in docs:
            kept = [s for s in d if s]
            ids.append(np.array([w for s in kept for w in s], dtype=np.int32))
            lens.append(np.array([len(s) for s in kept], dtype=np.int32))
            counts.append(len(kept))
            rest.append(float(len(d) - len(kept)))
        self.ids, self.lens, self.rest = np.concatenate(ids), np.concatenate(lens), np.array(rest)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + (np.add.reduceat(w[self.ids], self.starts) if len(self.lens) else np.zeros(0))


def loss_and_gradient(bags: Bags, y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float, leak: float) -> tuple[float, np.ndarray, float, float]:
    """Negative log-likelihood of document labels, and its gradient by w, bias and the leak's logit."""
    z = bags.logits(w, bias)
    total = softplus(leak) + np.bincount(bags.doc, softplus(z), len(y)) + bags.rest * softplus(bias)
    loss = float((weight * np.where(y, -np.log(-np.expm1(-total)), total)).sum())
    by_total = weight * np.where(y, -1 / np.expm1(np.minimum(total, 700)), 1.0)
    by_z = by_total[bags.doc] * sigmoid(z)
    by_w = np.bincount(bags.ids, np.repeat(by_z, bags.lens), len(w))
    return loss, by_w, float(by_z.sum() + (by_total * bags.rest).sum() * sigmoid(bias)), float(by_total.sum() * sigmoid(leak))


def learn(bags: Bags, y: np.ndarray, weight: np.ndarray, size: int, rounds: int, rate: float, l1: float, l2: float) -> tuple[np.ndarray, float, float]:
    """(w, bias, leak's logit) by proximal gradients with a rate per coordinate."""
    x = np.concatenate([np.zeros(size), [-6.0, -4.0]])
    seen = np.full(size + 2, 1e-6)
    for _ in range(rounds):
        _, g, gb, gl = loss_and_gradient(bags, y, weight, x[:size], x[-2], x[-1])
        g = np.concatenate([g + l2 * x[:size], [gb, gl]])
        seen += g * g
        step = rate / np.sqrt(seen)
        x -= step * g
        x[:size] = np.sign(x[:size]) * np.maximum(0, np.abs(x[:size]) - step[:size] * l1)
    return x[:size], float(x[-2]), float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 5000,
        least_share: float = 0.002, rounds: int = 300, rate: float = 0.5, l1: float = 0.1, l2: float = 1e-3) -> dict:
    """A model from the rows of `docs` that `labels` (doc_id, label 0 or 1) marks.

    It is fitted on a sample bounded by the parameter `per_label`: of each label the identifiers with the least hashes, and of their texts as many. Weights
    restore the proportion of labels, counted over all rows of `labels`. Of several labels of a document the largest holds; null ones, null identifiers
    and null texts are passed over. Words and beginnings are learned that occur in at least two and in a share of `least_share` of the sampled toxic documents, which
    bounds their number by a document's words over that share. Without documents of either label every score is the leak, the share of toxic labels.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg((F.max(label) >= 1).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    none = {"words": {}, "bias": -30.0, "leak": math.log(max(share, 1e-6) / max(1 - share, 1e-6))}
    if len(sizes) < 2:
        return none
    ids = marks.withColumn("h", F.md5(F.col("k").cast("string")))
    chosen = [r for y in (0, 1) for r in ids.where(F.col("y") == y).orderBy("h").limit(per_label).select("k", "y").collect()]
    # at most 2 * per_label identifiers
    sent = F.broadcast(spark.createDataFrame(chosen, marks.schema["k"].dataType.simpleString().join(["k ", ", y int"])))

    def bags_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": batch["h"], "y": batch["y"], "bag": ["\n".join(" ".join(sorted(words(t[a:b]))) for a, b in sentences(t)) for t in batch["text"]]})

    found = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).where("text IS NOT NULL").join(sent, "k")
    found = found.select(F.md5(F.concat_ws("|", F.col("k").cast("string"), F.md5("text"))).alias("h"), "y", "text").mapInPandas(bags_of, "h string, y int, bag string")
    rows = [r for y in (0, 1) for r in found.where(F.col("y") == y).dropDuplicates(["h"]).orderBy("h").limit(per_label).collect()]
    y = np.array([r["y"] == 1 for r in rows], dtype=bool)
    if not y.any() or y.all():
        return none
    frequent = Counter(f for r in rows if r["y"] for f in {f for w in set(r["bag"].split()) for f in features(w)})
    least = max(2, math.ceil(least_share * y.sum()))
    names = sorted(w for w, n in frequent.items() if n >= least)
    number = {w: i for i, w in enumerate(names)}
    bags = Bags([[number[f] for w in s.split(" ") for f in features(w) if f in number] for s in r["bag"].split("\n")] if r["bag"] else [] for r in rows)
    weight = np.where(y, 1.0, sizes[0] / max(1, (~y).sum()) / (sizes[1] / y.sum()))
    w, bias, leak = learn(bags, y, weight, len(names), rounds, rate, l1, l2)
    return {"words": {names[i]: float(w[i]) for i in np.flatnonzero(w)}, "bias": bias, "leak": leak}


class Weights:
    """What a word adds to its sentence's logit, remembered for up to `most` words at a time."""

    def __init__(self, model: dict, most: int = 200_000):
        self.known, self.most, self.seen = model["words"], most, {}

    def __call__(self, word: str) -> float:
        if (x := self.seen.get(word)) is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            x = self.seen[word] = math.fsum(self.known.get(f, 0.0) for f in features(word))
        return x


def judged(text: str | None, model: dict, weight: Weights) -> tuple[float, int, list[tuple[int, int, float]]]:
    """(score, number of sentences, offending sentences as (start, length, probability)) of one text."""
    spans = sentences(text or "")
    base = math.log1p(math.exp(model["bias"]))
    total, bad = math.log1p(math.exp(model["leak"])) + base * len(spans), []
    own = {w: x for w in words(text or "") if (x := weight(w)) != 0}
    if own:
        for a, b in spans:
            if here := words(text[a:b]) & own.keys():
                z = min(model["bias"] + math.fsum(own[w] for w in here), 500.0)
                total += math.log1p(math.exp(z)) - base
                if (p := 1 / (1 + math.exp(-z))) >= OFFENDING:
                    bad.append((a, b - a, p))
    return -math.expm1(-max(total, 0.0)), len(spans), bad


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds to every row of `df` score (double, the probability that it is toxic), n_sentences (long) and offending, an array of the
    sentences (start, length, score; in code points) that make it so.

    Null and empty texts have no sentence and get the model's leak. Texts are taken whole; equal texts get equal scores; columns of `df` with these
    names are replaced; an empty table gives an empty table. One pass without a shuffle; the model's size is bounded, see `fit`.
    """
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = "struct<score:double,n_sentences:long,offending:array<struct<start:long,length:long,score:double>>>"

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight = Weights(sent.value)
        for batch in batches:
            out = [judged(t, sent.value, weight) for t in batch]
            yield pd.DataFrame({"score": [r[0] for r in out], "n_sentences": [r[1] for r in out],
                                "offending": [[{"start": a, "length": n, "score": p} for a, n, p in r[2]] for r in out]})

    new = ["score", "n_sentences", "offending"]
    kept = [c for c in df.columns if c.lower() not in new]
    name = free_name(df, "toxic")
    return df.withColumn(name, judge(F.col(text))).select(*kept, *[F.col(f"{name}.{c}").alias(c) for c in new])
