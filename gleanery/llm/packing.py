"""Hierarchical residual packing of token sequences.

Chunks of pieces are best-fitted by themselves and their nearly full bins are emitted. What is left in underfull bins goes up a
tree: each round brings several groups together, best-fits what they left and emits in turn; the last group emits all. Pieces of
one length are alike, so a group is no more than how many pieces each length has, however many rows stand behind it, and none of
its bins has to be closed early. Each piece then follows its number among the pieces of its length up to the round that emits it.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches, written

#: Marks that are tokens apart from the letter before them.
MARKS = (".", ",", ";", ":", "!", "?")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class PieceEncoder(dict):
    """Token ids (bytes of little-endian unsigned 32-bit numbers) of space-separated parts, remembered.

    The splitting pattern of byte-level vocabularies joins one space to the word behind it, so a text whose white
    space is single spaces and line ends, none beside another, has the tokens of its parts, each with the space or line end
    before it. A part has in turn the tokens of that line end, of its word and of the mark that closes it.
    Any other text, and one that may hold a special string, is encoded whole. At most about 2 * `most` parts are remembered, in two
    generations: as soon as the young one is full it becomes the old one, and parts of the old one that come again move to the young.
    """

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.heads = sorted({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.odd = re.compile(r"[^\S\n ]|[\x1c-\x1f]").search
        self.marks = dict(zip(MARKS, self.whole(list(MARKS)), strict=True))
        self.line_end = self.whole(["\n"])[0]
        self.old: dict[str, bytes] = {}
        # how the vocabulary writes bytes: printable ones as themselves, the others as letters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.model, self.space = self.library.model, self.alphabet[32]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() if LITTLE else np.asarray(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:].isspace() or text[:1].isspace()
                    or not text.replace("\n", "").isprintable() and self.odd(text) or any(h in text for h in self.heads))

    def word(self, text: str) -> bytes:
        """The ids of one part as it stands in a text. Letters, with a space ahead or not, are one piece of the splitting pattern, so
        the model alone tells their tokens; beyond U+024F, where versions of Unicode may differ in what is a letter, the whole library does."""
        letters = text[1:] if text[0] == " " else text
        if letters.isascii() and letters.isalpha():
            named = text.replace(" ", self.space)
        elif letters.isalpha() and max(letters) < "\u0250":
            named = text.encode().decode("latin-1").translate(self.alphabet)
        else:
            return self.whole([text])[0]
        ids = array("I", [t.id for t in self.model.tokenize(named)])
        if not LITTLE:
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, part: str) -> bytes:
        """Remembers the ids of `part`, named as in `batch`."""
        ids = self.old.get(part)
        if ids is None:
            if part[-1] in MARKS and part[-2:-1].isalpha():
                ids = self[part[:-1]] + self.marks[part[-1]]
            elif part[0] == "\n":
                ids = self.line_end + self.word(part[1:])
            else:
                ids = self.word(part[1:] if part[0] == "\t" else " " + part)
        self[part] = ids
        return ids

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. A part is named by its letters if a space is before it, with the line end if that is
        before it, and with a tab, which no plain text has, if the text begins with it."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.__getitem__
        return [b"" if not text else b"".join(map(ids, ("\t" + text).replace("\n", " \n").split(" "))) if self.plain(text) else self.whole([text])[0]
                for text in texts]


@lru_cache(maxsize=4)
def encoder(path: str, most: int = 500_000) -> PieceEncoder:
    """One per Python worker and vocabulary."""
    return PieceEncoder(path, most)


def pieces(df: DataFrame, vocabulary: str, size: int, end_id: int, doc_id: str = "doc_id", text: str = "text", remembered: int = 500_000) -> DataFrame:
    """The token pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids (null: none) and then `end_id`. One longer than `size` is cut so that all
    pieces but the first have `size` tokens. Repeated rows have pieces of their own, nulls in other columns are of no account, and an
    empty table gives an empty table. `remembered` bounds what a worker keeps of parts already encoded (about 400 bytes each, two
    generations) and bears on time alone. One pass without a shuffle.
    """
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, ids in zip(batch["doc_id"], encoder(vocabulary, remembered).batch(list(batch["text"])), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                rows += [(key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bins of `lengths` by best fit, longest first: (bin, offset) of each item, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # by free space
    mask = n = 0  # bit f of mask: a bin with f free tokens is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        above = mask >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
        else:
            free, b, n = size, n, n + 1
        bins[i], offsets[i] = b, size - free
        if left := free - length:
            open_at[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def fitted(counts: dict[int, int], size: int) -> tuple[np.ndarray, int, list[list[tuple[int, int]]]]:
    """Best fit, longest first, of `counts` (length: items): as many bins as `best_fit` gives the same items.

    Rows are (length, number of the run's first item among those of its length, first bin, items a bin, offset in the
    bin), ascending; then come the number of bins and those not full, as (first bin, bins) by free space. Bins with equal free space take the items of a length in
    turn, each as many as it holds, since the bin that took one is the tightest for the next.
    """
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first bin, bins) by free space
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]

        def fill(free: int, first: int, m: int) -> None:
            nonlocal at
            each = free // length if length else n
            full = min(m, (n - at) // each)
            part = n - at - full * each if full < m else 0
            for b, k, of in ((first, each, full), (first + full, part, 1 if part else 0)):
                if of:
                    runs.append((length, at, b, k, size - free))
                    at += k * of
                    if left := free - k * length:
                        open_at[left].append((b, of))
            if rest := m - full - (part > 0):
                open_at[free].append((first + full + (part > 0), rest))

        for free in range(length, size + 1):
            while open_at[free] and at < n:
                fill(free, *open_at[free].pop())
            if at == n:
                break
        if at < n:
            new = -(-(n - at) // (size // length if length else n))
            bins += new
            fill(size, bins - new, new)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins, open_at


def best_fit_runs(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """The runs and the number of bins of `fitted`."""
    return fitted(counts, size)[:2]


def emitted_runs(counts: dict[int, int], size: int, slack: int) -> list[tuple]:
    """The runs of `fitted`, cut where nearly full bins (at most `slack` tokens free) and others meet.

    Rows are (length, first, last, bin, each, offset, done, rest): items first to last - 1 of their length, bins from `bin` on. If the
    bins are nearly full, the run is done; if not, its items go up, numbered anew from `rest` among those of their length.
    """
    runs, _, open_at = fitted(counts, size)
    under = sorted((b, b + m) for free in range(slack + 1, size + 1) for b, m in open_at[free])
    starts, rest, out, rows = [u[0] for u in under], {}, [], runs.tolist()
    for i, (length, at, b, each, offset) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else counts[length]
        x, stop, j = b, b - (at - end) // each, max(bisect_right(starts, b) - 1, 0)
        while x < stop:
            while j < len(under) and under[j][1] <= x:
                j += 1
            done = j == len(under) or under[j][0] > x
            to = stop if j == len(under) else min(stop, under[j][0 if done else 1])
            first, last, r = at + (x - b) * each, min(at + (to - b) * each, end), rest.get(length, 0)
            out.append((length, first, last, x, each, offset, done, r))
            if not done:
                rest[length] = r + last - first
            x = to
    return out


def pack(items: DataFrame, size: int = 1024, slack: int = 2, fan_in: int = 16, chunk: int = 65_536) -> DataFrame:
    """Places every row of `items` (as of `pieces`) in a sequence: adds sequence_id and offset (long).

    No sequence exceeds `size`; offsets are gapless from 0. `slack` is the free space of a bin that counts as nearly full,
    `fan_in` the groups that meet in a round (about, as a hash assigns them), `chunk` the pieces of a group of the first round. An underfull bin
    goes up by the pieces in it, as a whole it would fit in next to no other (bins of 600 meet bins of 2 * 424). Repeated rows are
    items of their own. An empty table gives an empty table. A task holds a chunk's pieces, or the counts of `size` lengths a group. Rounds
    grow with the logarithm of the number of chunks and touch counts alone; pieces are written twice and shuffled once.
    """
    kind = dict(items.dtypes)["doc_id"]
    plain = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, seen = TaskContext.get().partitionId() << 16, np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            if seen.sum() >= chunk:
                grp, seen = grp + 1, np.zeros(size + 1, dtype=np.int64)
            n = batch["length"].to_numpy()
            yield batch.assign(chunk=np.int64(grp), nth=seen[n] + batch.groupby("length").cumcount().to_numpy())
            seen += np.bincount(n, minlength=size + 1)

    # written before they are numbered: two Python steps in one task would take two workers, and each worker comes to keep the encoder of `pieces`
    items = written(items.select(*columns), "pieces")
    table = written(items.mapInPandas(numbered, f"{plain}, chunk long, nth long"), "pack")
    # what a chunk has left of a length: the items lo to lo + n - 1 of its group
    spans = written(table.groupBy("chunk", "length").agg(F.count("*").alias("n")).select(
        "chunk", F.col("chunk").alias("grp"), "length", F.lit(0).cast("long").alias("lo"), "n"), "spans")
    groups, top = spans.agg(F.countDistinct("grp"), F.max("grp")).first()
    level, width, paths = 0, (top or 0) + 1, []
    while True:
        paths.append(climbed(spans, level, width, -(-groups // fan_in) if groups > 1 else 0, size, slack))
        if groups <= 1:
            break
        level, groups = level + 1, -(-groups // fan_in)
        width = groups
        spans = paths[-1].where("NOT done").groupBy("chunk", F.col("parent").alias("grp"), "length").agg(
            F.expr("min(greatest(first, lo) + up)").alias("lo"), F.expr("sum(least(last, lo + n) - greatest(first, lo))").alias("n"))
    path = paths[0]
    for more in paths[1:]:
        path = path.unionByName(more)

    def placed(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        length, nth, left = rows["length"].to_numpy(), rows["nth"].to_numpy().copy(), np.arange(len(rows))
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for _, r in runs.sort_values(["level", "length", "first"]).groupby("level"):
            first, bin, each, start, done, up, scale, shift = (r[c].to_numpy() for c in ("first", "bin", "each", "offset", "done", "up", "scale", "shift"))
            k = np.searchsorted((r["length"].to_numpy() << 48) + first, (length[left] << 48) + nth[left], side="right") - 1
            inside = nth[left] - first[k]
            sequence[left] = (bin[k] + inside // each[k]) * scale[k] + shift[k]
            offset[left] = start[k] + inside % each[k] * length[left]
            nth[left] += up[k]
            left = left[~done[k]]
        return rows[columns].assign(sequence_id=sequence, offset=offset)

    path = path.select("chunk", "level", "length", "first", "bin", "each", "offset", "done", "up", "scale", "shift")
    return table.groupBy("chunk").cogroup(path.groupBy("chunk")).applyInPandas(placed, f"{plain}, sequence_id long, offset long")


def climbed(spans: DataFrame, level: int, width: int, parents: int, size: int, slack: int) -> DataFrame:
    """Best-fits every group of `spans` (chunk, grp, length, lo, n) and tells each chunk the runs that its items are in (written).

    `parents` is the number of groups of the next round; 0: this is the last one and all bins are done. Adds the run (as of
    `emitted_runs`), for items that go up the group `parent` and `up`, what is added to their number, and for a sequence's
    number bin * `scale` + `shift`, where group numbers are below `width`. A group's task holds the counts of its lengths alone.
    """
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        runs = emitted_runs(dict(zip(rows["length"].tolist(), rows["n"].tolist(), strict=True)), size, slack if parents else size)
        out = pd.DataFrame(runs, columns=["length", "first", "last", "bin", "each", "offset", "done", "rest"])
        return out.assign(grp=rows["grp"].iloc[0])

    counts = spans.groupBy("grp", "length").agg(F.sum("n").alias("n"))
    runs = written(counts.groupBy("grp").applyInPandas(
        fit, "grp long, length long, first long, last long, bin long, each long, offset long, done boolean, rest long"), "runs")
    # groups that meet number their items of a length one after the other
    left = runs.where("NOT done").groupBy("grp", "length").agg(F.expr("sum(last - first)").alias("m"))
    left = left.withColumn("parent", F.pmod(F.xxhash64("grp", F.lit(level)), F.lit(max(parents, 1))).cast("long"))
    before = F.sum("m").over(Window.partitionBy("parent", "length").orderBy("grp")) - F.col("m")
    runs = runs.join(left.select("grp", "length", "parent", before.alias("before")), ["grp", "length"], "left")
    return written(spans.join(runs, ["grp", "length"]).where("first < lo + n AND last > lo").select(
        "chunk", F.lit(level).alias("level"), "length", "lo", "n", "first", "last", "bin", "each", "offset", "done", "parent",
        F.expr("IF(done, 0L, rest - first + before)").alias("up"), F.lit(32 * width).cast("long").alias("scale"),
        (F.col("grp") * 32 + level).alias("shift")), "climbed")
