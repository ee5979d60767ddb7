"""Near-duplicate documents by ProbMinHash, banding and verification.

The different five-word shingles of a text are elements of a Poisson process, weighted by how often they occur: each
arrives again and again, after exponential waits whose mean is the inverse of its weight, at a register drawn at random,
and a register keeps its first visitor. Arrivals end as soon as none can be first any more. Two texts agree on a register
with the probability Jaccard similarity of their weighted shingles. Weights are damped, from 1 for a shingle that occurs
once to less than 1.5, so that a passage that one text repeats does not hide the rest: counts alone lower the similarity
of two texts by a tenth at most. Registers are banded; documents that share a band are candidates, and a link is a
candidate pair that the exact Jaccard similarity of the sets of shingles confirms.

Within a band's bucket all members are held against one hub, the member that shares most buckets; only those that
do not end up in the hub's class are held against the other members, and of these pairs only those whose distances
from the hub differ by no more than a link may span (Jaccard distance is a metric), whose shingles that occur in
other such texts are as many as a link needs, and whose parities of hashed shingles differ in no more bits than the sets of a
link may differ in shingles. So classes are exact for all candidate pairs, while a large group of copies costs one
exact comparison per member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import components, free_name, maybe_broadcast, small_batches, written

_U = np.uint64
#: Words of 64 bits that hold, per bit, whether an odd number of a set's shingles has that hash.
PARITIES = tuple(f"p{i}" for i in range(16))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of `k` words, ascending, with their counts; of all words if there are fewer."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out + h[i:i + n] + _U(i + 1))
    return np.unique(out, return_counts=True)


def damped(counts: np.ndarray) -> np.ndarray:
    """The weights of shingles that occur so often: 1, 1.25, 1.33 and so on, below 1.5."""
    return 1.5 - 0.5 / counts


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that each register saw first."""
    first, seen = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
    at, state, e, w = np.zeros(len(elements)), mixed(elements + _U(0x9E3779B97F4A7C15)), elements, weights.astype(float)
    while len(e):
        state = mixed(state + _U(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> _U(12)).astype(float) + 0.5) / 2.0**52) / w
        live = at < first.max()  # others can be first nowhere, now or later
        if not live.all():
            at, state, e, w = at[live], state[live], e[live], w[live]
        if not len(e):
            break
        where = (mixed(state ^ _U(0xD6E8FEB86659FD93)) % _U(registers)).astype(np.int64)
        order = np.lexsort((e, at))[::-1]  # the earliest is written last
        r, t, x = where[order], at[order], e[order]
        best, who = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
        best[r], who[r] = t, x
        better = best < first
        first[better], seen[better] = best[better], who[better]
    return seen


def bands_of(seen: np.ndarray, bands: int) -> np.ndarray:
    rows = seen.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        h = mixed(h + rows[:, i])
    return h.view(np.int64)


def near_classes(df: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = 24, rows: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `df`: doc_id, _row, class_id (the class's smallest doc_id), kept (true for one row of each class).

    Rows with the same words are one class; so are rows linked by a chain of texts, each with a Jaccard similarity of
    `similarity` or more to the next. Words are runs of anything but ASCII white space. A text of fewer than `words` words
    has them all as its one shingle; a null text and one without a word are classes of their own. Kept is the row with the
    smallest doc_id, null last, and of these the first. Rows with equal or null doc_id are documents of their own. Texts are
    taken whole; other columns are not used; an empty table gives an empty table. `df` must give the same rows in the same
    order when read again.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, row in zip(batch["doc_id"], batch["text"], batch["row"], strict=True):
                w = (t or "").encode("utf-8", "surrogatepass").split()
                if w:
                    s, n = shingles(w, words)
                    out.append((key, row, hashlib.md5(b" ".join(w)).digest(), bands_of(prob_min_hash(s, damped(n), bands * rows), bands)))
                else:
                    out.append((key, row, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "row", "h", "bands"])

    sketched = written(docs.mapInPandas(sketch, f"doc_id {dict(df.dtypes)[doc_id]}, row long, h binary, bands array<long>"), "sketch")
    reps = written(sketched.where("h IS NOT NULL").groupBy("h").agg(F.min(F.struct("row", "bands")).alias("r")).select("h", "r.row", "r.bands"), "reps")

    # members of buckets that two different texts share, and the hub of each
    exploded = reps.select("row", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = written(exploded.join(shared, "key"), "members")
    weight = written(member.groupBy("row").agg(F.sum("n").alias("weight")), "weights")
    n_weight = weight.count()
    hubs = written(member.join(maybe_broadcast(weight, n_weight), "row").groupBy("key").agg(F.max(F.struct("weight", F.expr("-row").alias("r"))).alias("m")).selectExpr("key", "-m.r AS hub"), "hubs")
    starred = member.select("key", "row").join(hubs, "key")

    # the sets of shingles of the members
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "s": [shingles((t or "").encode("utf-8", "surrogatepass").split(), words)[0].tobytes() for t in batch["text"]]})

    chosen = docs.select("row", "text").join(maybe_broadcast(weight.select("row"), n_weight), "row", "left_semi")
    shingled = written(chosen.mapInPandas(sets, "row long, s binary"), "sets")

    def jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b in zip(batch["s_a"], batch["s_b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "j": out})

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one, two = (shingled.selectExpr(f"row AS {c}", f"s AS s_{c}") for c in "ab")
        return written(pairs.join(one, "a").join(two, "b").mapInPandas(jaccard, "a long, b long, j double"), name)

    near = verified(starred.where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct(), "near")
    link = F.col("j") >= similarity
    label = written(components(near.where(link).select("a", "b")), "labels")

    # what is not in its hub's class against the bucket's other members
    known = (starred.join(label.selectExpr("id AS row", "component_id AS c"), "row", "left").join(label.selectExpr("id AS hub", "component_id AS hub_c"), "hub", "left")
             .join(near.selectExpr("a AS row", "b AS hub", "j"), ["row", "hub"], "left")
             .select("key", "row", F.coalesce("c", "row").alias("c"), F.coalesce("hub_c", "hub").alias("hub_c"), "hub", F.coalesce("j", F.lit(1.0)).alias("j")))
    known = written(known, "known")
    undecided = known.join(known.where("c <> hub_c").select("key").distinct(), "key", "left_semi")
    rest = written(undecided.select("row").distinct(), "rest")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [np.frombuffer(b, np.int64) for b in batch["s"]]
            yield pd.DataFrame({"x": np.concatenate(x), "row": np.repeat(batch["row"].to_numpy(), [len(v) for v in x])})

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch["s"]]
            bits = np.array([np.bincount((x % _U(64 * len(PARITIES))).astype(np.int64), minlength=64 * len(PARITIES)) & 1 for x in sets], dtype=np.uint8).reshape(len(sets), -1)
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pd.DataFrame({"row": batch["row"], "size": [len(x) for x in sets], **{p: packed[:, i] for i, p in enumerate(PARITIES)}})

    # shingles that no other of these texts has can't be shared, which bounds what two texts may have in common
    own = shingled.join(maybe_broadcast(rest, rest.count()), "row", "left_semi")
    alone = own.mapInPandas(spread, "x long, row long").groupBy("x").agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n = 1").groupBy("row").agg(F.count("*").alias("alone"))
    bounds = own.mapInPandas(odd, "row long, size long, " + ", ".join(f"{p} long" for p in PARITIES)).join(alone, "row", "left")
    bounds = bounds.select("row", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"), *PARITIES)
    undecided = undecided.join(written(bounds, "bounds"), "row")
    sketch_of = lambda side: [f"{p} AS {side}_{p}" for p in PARITIES]
    out_of = undecided.where("c <> hub_c").selectExpr("key", "row AS a", "c AS a_c", "j AS a_j", "size AS a_size", "common AS a_common", *sketch_of("a"))
    others = undecided.where("row <> hub").selectExpr("key", "row AS b", "c AS b_c", "hub_c = c AS inside", "j AS b_j", "size AS b_size", "common AS b_common", *sketch_of("b"))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES])
    alike = differ <= (F.col("a_size") + F.col("b_size")) * (1 - similarity) / (1 + similarity) + 1e-6
    enough = F.least("a_common", "b_common") * (1 + similarity) >= (F.col("a_size") + F.col("b_size")) * similarity - 1e-6
    more = (out_of.join(others, "key").where((F.col("a_c") != F.col("b_c")) & (F.col("inside") | (F.col("a") < F.col("b"))) & (F.abs(F.col("a_j") - F.col("b_j")) <= 1 - similarity + 1e-9) & enough & alike)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = verified(more, "more")
    label = components(near.where(link).select("a", "b").unionByName(more.where(link).select("a", "b")))

    by_text = reps.select("h", "row").join(label.withColumnRenamed("id", "row"), "row", "left").select("h", F.coalesce("component_id", "row").alias("c"))
    placed = written(sketched.select("doc_id", "row", "h").join(by_text, "h", "left").select("doc_id", "row", F.coalesce("c", "row").alias("c")), "placed")
    least = placed.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select("c", F.col("m.doc_id").alias("class_id"), F.col("m.row").alias("first"))
    return placed.join(written(least, "classes"), "c").select("doc_id", F.col("row").alias("_row"), "class_id", (F.col("row") == F.col("first")).alias("kept"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of `df` that `near_classes` keeps, with the columns of `df`, whatever their names.

    Null texts and texts without a word all stay, nulls in other columns are of no account, of repeated rows the first stays, and an
    empty table gives an empty table.
    """
    row = free_name(df, "row")
    gone = written(near_classes(df, doc_id=doc_id, text=text, **parameters).where("NOT kept").select(F.col("_row").alias(row)), "gone")
    return df.withColumn(row, F.monotonically_increasing_id()).join(maybe_broadcast(gone, gone.count()), row, "left_anti").select(*df.columns)
