"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights come from follow-the-regularised-leader with per-coordinate rates and elastic-net penalties; a
temperature fitted on rows set aside calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_name, small_batches

_OTHER = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def grams(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed character bigrams and trigrams (bucket, count) of the letters of `text`; None if it has no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    if not plain or not any(map(str.isalpha, plain[:64])) and not any(map(str.isalpha, plain)):
        return None
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = (two[:-1] * np.uint32(0x85EBCA6B) + c[2:]) * np.uint32(0xC2B2AE35)
    both = np.concatenate([two * np.uint32(0x27D4EB2F), three])
    counts = np.bincount((both ^ (both >> np.uint32(15))) & np.uint32(buckets - 1), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression on sparse rows."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    a, b, r = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def is_held_out(doc_id: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the identifier as text has this remainder; false for a null one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 600, buckets: int = 1 << 15,
        epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> dict:
    """A model from `labelled` rows, of which null languages and texts without letters are passed over.

    Document frequencies are counted over all of them. The weights are fitted on a sample that is bounded by
    the parameter `per_label`: the rows of each language with the least hashes of identifier and text.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(doc_id).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return {"labels": [], "buckets": buckets}

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for t in batch["text"]:
                if (g := grams(t, buckets)) is not None:
                    df[g[0]] += 1
                    df[buckets] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at, "n": df[at]})

    df = np.zeros(buckets + 1)
    for r in rows.select("text").mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[buckets]) / (1 + df[:buckets])) + 1

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(h, y, *(x.astype("<i4").tobytes() for x in g)) for h, y, t in zip(batch["h"], batch["lang"], batch["text"], strict=True) if (g := grams(t, buckets)) is not None]
            yield pd.DataFrame(found, columns=["h", "lang", "at", "n"])

    share = F.create_map(*[x for y in labels for x in (F.lit(y), F.lit(min(1.0, 1.2 * per_label / sizes[y])))])
    drawn = rows.withColumn("h", F.md5(F.concat(F.coalesce("k", F.lit("")), F.lit("|"), F.md5("text")))).where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 < share[F.col("lang")])
    by_label: dict[str, list] = {y: [] for y in labels}
    for r in drawn.select("h", "lang", "text").mapInPandas(features, "h string, lang string, at binary, n binary").collect():
        by_label[r["lang"]].append((r["h"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")))
    sample = sorted(((h, at, tfidf(at, n, idf), i) for i, y in enumerate(labels) for h, at, n in sorted(by_label[y], key=lambda r: r[0])[:per_label]), key=lambda r: (r[0], r[3]))
    aside, learnt = sample[::5], [s for i, s in enumerate(sample) if i % 5] or sample
    model = Ftrl(buckets, len(labels), alpha, beta, l1, l2)
    for _ in range(epochs):
        for _, at, x, y in learnt:
            model.learn(at, x, y)
    w = model.weights(slice(None))
    heat = temperature(np.array([x @ w[at] for _, at, x, _ in aside]), np.array([y for *_, y in aside])) if aside else 1.0
    return {"labels": labels, "buckets": buckets, "idf": idf, "w": w, "t": heat, "nonzero": int((w != 0).sum())}


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred (string) and score (double, the calibrated probability) to every row of `df`.

    `und` with score 0 for a null text, one without a letter, and a model without labels. Texts are taken whole;
    equal texts get equal predictions; columns of `df` with these names are replaced; an empty table gives an
    empty table. One pass without a shuffle; the model's size is bounded by its buckets and labels.
    """
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            out = []
            for t in batch:
                g = grams(t, m["buckets"]) if m["labels"] else None
                if g is None:
                    out.append((UNDETERMINED, 0.0))
                    continue
                p = softmax(tfidf(*g, m["idf"]) @ m["w"][g[0]] / m["t"])
                best = int(p.argmax())
                out.append((m["labels"][best], float(p[best])))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = [c for c in df.columns if c.lower() not in {"lang_pred", "score"}]
    name = free_name(df, "lang")
    return df.withColumn(name, predict(F.col(text))).select(*kept, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
