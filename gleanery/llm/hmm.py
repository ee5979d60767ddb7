"""A hidden Markov language model.

Tokens are the words of a text, A-Z in lower case, and one end. The most frequent words are symbols of their
own, every other word belongs to a class of words with the same ending; a state emits symbols, a class emits
its words by their smoothed counts. Baum-Welch counts of all training documents are aggregated across
partitions; scaled forward recursion computes the exact likelihood of each sequence.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches, written

#: Weight of a word that was never seen, and bytes of a word's ending that make its class.
UNSEEN, ENDING = 0.1, 3
#: Steps in a block of the recursions, symbols in a portion of the documents that run through them together, and those sorted for it.
BLOCK, PORTION, MOST_TOKENS = 65_536, 300_000, 1_200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-ENDING:]) % classes


class Hmm:
    """start (S), move (S x S) and emit (symbols x S), each a distribution over its targets."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def _time_major(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents by falling length; symbols step by step, and the number of documents alive at each step."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        at = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(at[-1], dtype=np.int64)
        for row, i in enumerate(order):
            flat[at[:len(docs[i])] + row] = docs[i]
        return order, flat, at

    def _emitted(self, flat: np.ndarray) -> np.ndarray:
        """The probability of each symbol of `flat` by state, states x symbols: sums and quotients then run along the long side."""
        return np.take(np.ascontiguousarray(self.emit.T), flat, axis=1)

    def _forward(self, emitted: np.ndarray, at: np.ndarray, first: int, last: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward states (states x symbols) of the steps from `first` to before `last`, and their scales; `a`: states of the step before."""
        alphas, scales, across, o = np.empty_like(emitted), np.empty(emitted.shape[1]), np.ascontiguousarray(self.move.T), at[first]
        for t in range(first, last):
            x, y = at[t] - o, at[t + 1] - o
            now = alphas[:, x:y]
            now[:] = self.start[:, None] if t == 0 else across @ a[:, :y - x]
            now *= emitted[:, x:y]
            now.sum(0, out=scales[x:y])
            now /= scales[x:y]
            a = now
        return alphas, scales

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each symbol sequence, by scaled forward recursion."""
        order, flat, at = self._time_major(docs)
        total, a, steps = np.zeros(len(docs)), None, len(at) - 1
        for first in range(0, steps, BLOCK):
            last = min(steps, first + BLOCK)
            alphas, scales = self._forward(self._emitted(flat[at[first]:at[last]]), at, first, last, a)
            a, logs = alphas[:, at[last - 1] - at[first]:].copy(), np.log10(scales)
            for t in range(first, last):
                total[:at[t + 1] - at[t]] += logs[at[t] - at[first]:at[t + 1] - at[first]]
        out = np.empty(len(docs))
        out[order] = total
        return out

    def expect(self, docs: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Adds the expected counts of `docs` to (start, move, emit); returns their log10 likelihood. Forward states are
        kept at block ends only and computed again block by block, so memory does not grow with a text's length; where one
        block holds all steps, they are computed once."""
        starts, moves, emits = counts
        _, flat, at = self._time_major(docs)
        steps, k, likelihood = len(at) - 1, len(self.start), 0.0
        edges = [*range(0, steps, BLOCK), steps]
        saved: list[np.ndarray | None] = [None]  # the states before each block
        for first, last in zip(edges, edges[1:-1], strict=False):
            alphas, _ = self._forward(self._emitted(flat[at[first]:at[last]]), at, first, last, saved[-1])
            saved.append(alphas[:, at[last - 1] - at[first]:].copy())
        carried = np.ones((k, 0))
        for before, first, last in zip(saved[::-1], edges[-2::-1], edges[:0:-1], strict=True):
            symbols, o = flat[at[first]:at[last]], at[first]
            ahead = self._emitted(symbols)
            alphas, scales = self._forward(ahead, at, first, last, before)
            likelihood += np.log10(scales).sum()
            ahead /= scales
            betas = np.ones_like(ahead)  # where documents end they stay 1
            betas[:, at[last - 1] - o:][:, :carried.shape[1]] = carried
            for t in reversed(range(max(first, 1), last)):
                x, y = at[t] - o, at[t + 1] - o
                now = ahead[:, x:y]
                now *= betas[:, x:y]
                carried = self.move @ now
                if t > first:
                    then = at[t - 1] - o
                    betas[:, then:then + y - x] = carried
                    moves += self.move * (alphas[:, then:then + y - x] @ now.T)
                else:
                    moves += self.move * (before[:, :y - x] @ now.T)
            betas *= alphas  # the states' probabilities
            if first == 0:
                starts += betas[:, :at[1]].sum(1)
            for i in range(k):
                emits[:, i] += np.bincount(symbols, weights=betas[i], minlength=len(emits))
        return likelihood

    def zeros(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit)

    @classmethod
    def of_counts(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: float = 0.01) -> Hmm:
        a, b, c = starts + 0.1, moves + 1.0, emits + prior
        return cls(a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0))


def portions(docs: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """`docs` in lists of about PORTION symbols at most, those of like length together, as a list takes as many steps as its longest
    document: among each MOST_TOKENS symbols the longest come first, and equal ones in their order."""
    def cut(held: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        part, n = [], 0
        for d in sorted(held, key=len, reverse=True):
            if part and n + len(d) > PORTION:
                yield part
                part, n = [], 0
            part.append(d)
            n += len(d)
        if part:
            yield part

    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= MOST_TOKENS:
            yield from cut(held)
            held, n = [], 0
    yield from cut(held)


def symbols_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2")


def score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", states: int = 6, frequent: int = 32_768,
          classes: int = 1024, parts: int = 2, rounds: int = 6) -> DataFrame:
    """Per row of `df`: doc_id, held_out (not `train`), n_tokens, n_known, train_tokens (long), base_score and score (double).

    `train` is a boolean column of `df`; null counts as false. A null text is empty and has the end alone. The training rows
    are dealt into `parts` by a hash of their symbols. Each of `rounds` rounds of Baum-Welch counts one part anew under the
    present model, and the latest counts of all parts together make the next model (incremental expectation maximisation, whose
    likelihood never falls); so each training row is counted `rounds` / `parts` times, and no sample or place decides. base_score
    is that of the smoothed unigram model. Without training rows every token is unseen. Texts are taken whole; equal rows
    get equal scores; other columns of `df` are not used; an empty table gives an empty table.

    Word counts are pre-aggregated before the shuffle. Frequent words are those that occur as often as a threshold, the least that
    leaves `frequent` of them at most, found in a histogram of counts (16 classes to each power of two); rare words meet their
    counts in a shuffled join, where no word is frequent.
    """
    spark = df.sparkSession
    small_batches(spark)
    end, m = frequent + classes, frequent + classes + 1
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                c.update(words_of(t))
            if len(c) > 400_000:
                yield pd.DataFrame({"word": list(c.keys()), "c": list(c.values())})
                c.clear()
        yield pd.DataFrame({"word": pd.Series(list(c.keys()), dtype=object), "c": pd.Series(list(c.values()), dtype="int64")})

    counts = written(rows.where("train").select("text").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n_docs = rows.where("train").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + n_docs, distinct + (n_docs > 0)
    power = "shiftleft(1L, length(bin(c)) - 1)"
    found, least = 0, None  # words of c >= least are symbols
    for r in sorted(counts.groupBy(F.expr(f"length(bin(c)) * 16 + (c - {power}) * 16 DIV {power}").alias("k")).agg(F.min("c").alias("c"), F.count("*").alias("n")).collect(), reverse=True):
        found += r["n"]
        if found > frequent:
            break
        least = r["c"]
    top = [] if least is None else sorted((-r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).collect())
    top = [(w, -c) for c, w in top]
    number = {w: i for i, (w, _) in enumerate(top)}
    base = np.log10((np.array([*(c for _, c in top), n_docs], dtype=float) + UNSEEN) / (n + UNSEEN * (v + 1)))
    rare = counts if least is None else counts.where(F.col("c") < least)
    kind = F.crc32(F.expr(f"substring(word, greatest(length(word) - {ENDING - 1}, 1), {ENDING})")) % classes
    in_class, of_class = np.zeros(classes), np.zeros(classes)
    for r in rare.groupBy(kind.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        in_class[r["k"]], of_class[r["k"]] = r["c"], r["n"]
    sent = spark.sparkContext.broadcast((number, base))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, base = sent.value
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for key, t, is_train in zip(batch["doc_id"], batch["text"], batch["train"], strict=True):
                words = words_of(t)
                got = list(map(number.get, words))
                tail = Counter(w for w, i in zip(words, got, strict=True) if i is None)
                known = [i for i in got if i is not None]
                s = np.array([*(frequent + _class(w, classes) if i is None else i for w, i in zip(words, got, strict=True)), end], dtype="<u2")
                out.append((rid, key, bool(is_train), zlib.crc32(s.tobytes()) % parts, len(s), len(known) + (n_docs > 0), float(base[known].sum() + base[-1]), s.tobytes(), list(tail), list(tail.values())))
                rid += 1
            yield pd.DataFrame(out, columns=["rid", "doc_id", "train", "part", "n", "known", "base", "s", "rare", "times"])

    encoded = written(rows.mapInPandas(encode, f"rid long, doc_id {dict(df.dtypes)[doc_id]}, train boolean, part int, n long, known long, base double, s binary, rare array<binary>, times array<long>"), "symbols")

    # the model, from random initial values around the counts of all symbols
    rng = np.random.default_rng(7)
    usual = np.concatenate([[c for _, c in top], np.zeros(frequent - len(top)), in_class, [n_docs]]).astype(float)
    model = Hmm.of_counts(np.ones(states), np.full((states, states), 0.5) + 20 * np.eye(states), (usual[:, None] + 0.1) * rng.uniform(0.1, 1.9, (m, states)))
    latest = np.zeros((parts, m + states + 1, states))
    for i in range(rounds if n_docs else 0):
        now = spark.sparkContext.broadcast(model)

        def expected(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            acc = now.value.zeros()
            for part in portions(symbols_of(b) for batch in batches for b in batch["s"]):
                now.value.expect(part, acc)
            flat = np.concatenate([acc[2], acc[1], acc[0][None]])
            at = np.flatnonzero(flat.sum(1) > 1e-12)
            yield pd.DataFrame({"row": at, **{f"x{j}": flat[at, j] for j in range(states)}})

        counted = encoded.where(F.col("train") & (F.col("part") == i % parts)).select("s").mapInPandas(expected, "row long, " + ", ".join(f"x{j} double" for j in range(states)))
        latest[i % parts] = 0
        for r in counted.groupBy("row").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(states)]).collect():
            latest[i % parts, r[0]] = r[1:]
        now.unpersist()
        acc = latest.sum(0)
        model = Hmm.of_counts(acc[-1], acc[m:m + states], acc[:m])
    last = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush() -> pd.DataFrame:
            rows = pd.concat(held).sort_values("n", ascending=False, kind="stable", ignore_index=True)  # the order of `portions`
            logs = [last.value.log10(p) for p in portions(map(symbols_of, rows["s"]))]
            return rows.drop(columns="s").assign(hmm=np.concatenate(logs))

        for batch in batches:
            held.append(batch)
            n += int(batch["n"].sum())
            if n >= MOST_TOKENS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    scored = encoded.select("rid", "doc_id", "train", "n", "known", "base", "s").mapInPandas(
        likelihood, f"rid long, doc_id {dict(df.dtypes)[doc_id]}, train boolean, n long, known long, base double, hmm double")
    per_class = F.broadcast(spark.createDataFrame([(i, float(a + UNSEEN * (b + 1))) for i, (a, b) in enumerate(zip(in_class, of_class, strict=True))], "k int, mass double"))
    tail = (encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("rid", F.col("z.rare").alias("word"), F.col("z.times").alias("times"))
            .join(rare, "word", "left").withColumn("k", kind.cast("int")).join(per_class, "k")
            .withColumn("w", F.coalesce("c", F.lit(0)) + UNSEEN)
            .groupBy("rid").agg(F.sum(F.col("times") * (F.col("c") > 0).cast("long")).alias("t_known"), F.sum(F.expr(f"times * log10(w / {n + UNSEEN * (v + 1)!r}D)")).alias("t_base"),
                                F.sum(F.expr("times * log10(w / mass)")).alias("t_class")))
    return scored.join(tail, "rid", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("t_base", F.lit(0.0))).alias("base_score"),
        (F.col("hmm") + F.coalesce("t_class", F.lit(0.0))).alias("score"))
