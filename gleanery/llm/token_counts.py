"""Token counts by heap-and-linked-list byte-pair merging.

The number of tokens of a word is its number of initial symbols less the merges that a priority queue of
adjacent pairs performs, lowest rank first; no token identifier is made.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleanery.llm.common import small_batches

#: White space of the normaliser, and the pattern that cuts lower-case text into words.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


class MergeCounter(dict):
    """Token counts of white-space-separated chunks, remembered; the memory is emptied when it holds `most`."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end, self.alphabet, self.most = model.get("end_of_word_suffix") or "", byte_alphabet(), most
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.heads = [s[:2] for s in specials]

    def word(self, word: str) -> int:
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        merges = 0
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return n - merges

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        n = sum(self.word(x) for x in PIECES.findall(plain))
        if len(chunk) <= 64:  # longer ones are rare and would fill the memory
            self[chunk] = n
        return n

    def plain(self, text: str) -> int:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return sum(map(self.__getitem__, [x for x in SPACES.split(text) if x] if odd else text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials and any(h in text for h in self.heads):
            return len(self.specials.findall(text)) + sum(map(self.plain, self.specials.split(text)))
        return self.plain(text)


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    """One per Python worker and vocabulary."""
    return MergeCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > `limit`) to every row of `df`.

    `vocabulary` is the path, on every machine, of a byte-level BPE vocabulary in .json with word ends.
    A null or empty text has 0 bytes and 0 tokens; texts are taken whole, whatever their length; equal rows get
    equal counts; columns of `df` that bear these names are replaced; an empty table gives an empty table.
    One pass without a shuffle.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary).count
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return (df.withColumn("n_tokens", tokens(F.col(text)))
            .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
