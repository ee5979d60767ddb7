"""Near-duplicate vectors by epsilon grid order.

Unit vectors of a cosine of c or more lie within eps = sqrt(2 - 2c) of each other. They are sorted by the cells,
eps wide, of their leading principal components, and cut into blocks. Two blocks can hold a link only if their
bounds on every leading component are at most eps apart; pairs of blocks that may are joined by halving their
sequences for as long as bounds show that parts are too far apart, and the rest is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import components, maybe_broadcast, small_batches, written

#: Vectors that are compared at once.
LEAF = 128


def units(blobs: pd.Series, kind: str) -> np.ndarray:
    """The unit vectors of packed vectors of one length, in double precision."""
    x = np.stack([np.frombuffer(b, dtype=kind) for b in blobs]).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the bounds of two sets of leading components are more than `eps` apart."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > eps * eps


class Links:
    """What is known of the links between two sequences: each row's number of partners, and edges that hold components together."""

    def __init__(self, na: np.ndarray, nb: np.ndarray, same: bool):
        self.na, self.nb, self.shift = na.astype(float), nb.astype(float), 0 if same else len(na)
        self.mine, self.theirs, self.edges = np.zeros(len(na)), np.zeros(len(nb)), []

    def add(self, hit: np.ndarray, i: int, j: int) -> None:
        if not hit.any():
            return
        a, b = hit.shape
        weights = hit.astype(float)
        self.mine[i:i + a] += weights @ self.nb[j:j + b]
        self.theirs[j:j + b] += self.na[i:i + a] @ weights
        p, q = np.nonzero(hit)
        p, q = p + i, q + j + self.shift
        self.edges.append(forest(p, q) if len(p) > a + b else (p, q))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the links (a, b) to the smallest of its component: as many as there are nodes, at most."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        while not np.array_equal(further := new[new], new):
            new = further
        if (new[p] == new[q]).all():
            break
        label = new
    far = np.nonzero(new != np.arange(len(ids)))[0]
    return ids[far], ids[new[far]]


def join(x: np.ndarray, px: np.ndarray, i: int, y: np.ndarray, py: np.ndarray, j: int, eps: float, least: float, same: bool, links: Links) -> None:
    """Adds to `links` those of two sequences that start at rows `i` and `j`."""
    if not same and apart(px, py, eps):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        hit = x @ y.T >= least
        links.add(np.triu(hit, 1) if same else hit, i, j)
        return
    if same:
        h = len(x) // 2
        join(x[:h], px[:h], i, x[:h], px[:h], i, eps, least, True, links)
        join(x[h:], px[h:], i + h, x[h:], px[h:], i + h, eps, least, True, links)
        join(x[:h], px[:h], i, x[h:], px[h:], i + h, eps, least, False, links)
    elif len(x) >= len(y):
        h = len(x) // 2
        join(x[:h], px[:h], i, y, py, j, eps, least, False, links)
        join(x[h:], px[h:], i + h, y, py, j, eps, least, False, links)
    else:
        h = len(y) // 2
        join(x, px, i, y[:h], py[:h], j, eps, least, False, links)
        join(x, px, i, y[h:], py[h:], j + h, eps, least, False, links)


def pieces_of(axes: np.ndarray, kind: str, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function that cuts one stretch of the order into pieces of `block` rows, the last of up to twice as many, with their bounds."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId(), 0, None

        def piece(rows: pd.DataFrame) -> pd.DataFrame:
            p = units(rows["u"], kind) @ axes
            return pd.DataFrame([(part, n, b"".join(rows["u"]), rows["rep"].tolist(), rows["n"].tolist(), p.min(0).tolist(), p.max(0).tolist())], columns=["part", "piece", "x", "reps", "ns", "lo", "hi"])

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= 2 * block:
                yield piece(held.iloc[:block])
                held, n = held.iloc[block:].reset_index(drop=True), n + 1
        if held is not None and len(held):
            yield piece(held)

    return cut


def comparer(axes: np.ndarray, kind: str, eps: float, least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function that compares the two blocks of a pair, or the one of a pair with itself, given as their pieces."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows, sides = rows.sort_values(["part", "piece"]), []
        for block in sorted(set(rows["block"])):
            own = rows[rows["block"] == block]
            x = np.concatenate([units(pd.Series([blob[i:i + len(blob) // len(reps)] for i in range(0, len(blob), len(blob) // len(reps))]), kind) for blob, reps in zip(own["x"], own["reps"], strict=True)])
            sides.append((x, np.concatenate(list(own["reps"])), np.concatenate(list(own["ns"]))))
        same = len(sides) == 1
        (x, ra, na), (y, rb, nb) = sides[0], sides[-1]
        found = Links(na, nb, same)
        join(x, x @ axes, 0, y, y @ axes, 0, eps, least, same, found)
        node, load = np.concatenate([ra, rb]), np.concatenate([found.mine, found.theirs]).astype(np.int64)
        p, q = forest(*(np.concatenate(z) for z in zip(*found.edges, strict=True))) if found.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        some = load > 0
        return pd.DataFrame({"a": np.concatenate([node[some], node[p]]), "b": np.concatenate([np.full(some.sum(), -1), node[q]]), "load": np.concatenate([load[some], np.zeros(len(p), np.int64)])}).astype("int64")

    return compare


def near_vectors(df: DataFrame, cosine: float = 0.95, leading: int = 12, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row of `df`: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links),
    kept (vec_id = component_id).

    Rows are linked if the cosine of their vectors in double precision is `cosine` or more. A vector that is null, empty,
    zero or holds a null or a non-finite component links with nothing, nor do vectors of different lengths. Rows with the
    same vec_id are counted each and share a component. vec_id must not be null. Equal vectors are compared once. Other
    columns are not used; an empty table gives an empty table.

    What travels is each vector once for the sort, as wide as its column has it, and each block of `block` rows (fewer if
    they take over 8 MB) once for each block it may link with; links are summed and thinned to a forest where they are
    found, so a dense group costs no list of pairs.
    """
    spark = df.sparkSession
    small_batches(spark, 4096)
    kind = "<f4" if df.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["v"]:
                x = np.array(v, dtype=float) if v is not None else np.zeros(0)
                out.append((x + 0.0).astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "u": out})

    packs = written(rows.mapInPandas(packed, "vec_id long, u binary"), "packed")
    groups = written(packs.where("u IS NOT NULL").groupBy("u").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    lengths = [r[0] for r in groups.select(F.length("u")).distinct().collect()]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = units(batch["u"], kind)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9) + 1e-12
    loads, links = [], None
    for length in sorted(lengths):
        own = groups.where(F.length("u") == length)
        width = length // int(kind[-1]) + 1
        parts = own.select("u").mapInPandas(moments, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"x{k}") for k in range(width)]).orderBy("i").collect()
        m = np.array([r[1:] for r in parts])
        mean = m[0, 1:] / m[0, 0]
        _, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        axes = axes[:, ::-1][:, :leading]
        k, most = axes.shape[1], max(64, min(block, (8 << 20) // length))

        def cells(batches: Iterator[pd.DataFrame], axes=axes) -> Iterator[pd.DataFrame]:
            for batch in batches:
                # big-endian and unsigned, so that the order of bytes is that of the cells
                cell = np.clip(np.floor(units(batch["u"], kind) @ axes / eps), -(2.0**31), 2.0**31 - 1).astype(np.int64) + (1 << 31)
                yield batch.assign(cell=[c.tobytes() for c in cell.astype(">u4")])

        n_blocks = max(1, -(-int(m[0, 0]) // most))
        ordered = own.mapInPandas(cells, "u binary, rep long, n long, cell binary").repartitionByRange(n_blocks, "cell", "rep").sortWithinPartitions("cell", "rep")
        table = written(ordered.select("u", "rep", "n").mapInPandas(pieces_of(axes, kind, most), "part long, piece long, x binary, reps array<long>, ns array<long>, lo array<double>, hi array<double>"), "pieces")
        # where the order was cut into more parts than asked for, neighbours make up one block
        n_parts = (table.agg(F.max("part")).first()[0] or 0) + 1
        table = table.withColumn("block", F.expr(f"shiftleft(part * {min(n_blocks, n_parts)}L DIV {n_parts}L, 32) | piece"))
        bounds = table.groupBy("block").agg(*[F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(k)], *[F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(k)])
        # pairs of blocks that may link: they share a stretch of the first component, and no bound keeps them apart
        bounds = bounds.withColumn("stretch", F.explode(F.expr(f"sequence(CAST(floor(lo0 / {eps!r}D) AS LONG) - 1, CAST(floor(hi0 / {eps!r}D) AS LONG) + 1)")))
        gap = " + ".join(f"pow(greatest(0D, a.lo{i} - b.hi{i}, b.lo{i} - a.hi{i}), 2)" for i in range(k))
        pairs = written(bounds.alias("a").join(bounds.alias("b"), F.expr(f"a.stretch = b.stretch AND a.block <= b.block AND {gap} <= {eps * eps!r}D"))
                        .selectExpr("a.block AS a", "b.block AS b").distinct(), "blockpairs")
        n_pairs = pairs.count()

        sent = pairs.select(F.explode(F.expr("IF(a = b, array(a), array(a, b))")).alias("block"), F.xxhash64("a", "b").alias("pair"))
        joined = table.select("block", "part", "piece", "x", "reps", "ns").join(maybe_broadcast(sent, 2 * n_pairs), "block").repartition(max(1, min(n_pairs, 20_000)), "pair")
        found = written(joined.groupBy("pair").applyInPandas(comparer(axes, kind, eps, cosine), "a long, b long, load long"), "links")
        loads.append(found.where("load > 0").selectExpr("a AS rep", "load"))
        edges = found.where("load = 0").select("a", "b")
        links = edges if links is None else links.unionByName(edges)
    one = spark.createDataFrame([], "rep long, load long")
    for x in loads:
        one = one.unionByName(x)
    label = components(links if links is not None else spark.createDataFrame([], "a long, b long"))
    per = written(groups.join(one.groupBy("rep").agg(F.sum("load").alias("load")), "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
                  .select("u", (F.coalesce("load", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    return packs.join(per, "u", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
