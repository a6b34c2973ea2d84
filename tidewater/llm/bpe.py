"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pre-tokens; each starts as its UTF-8 bytes. The lowest-ranked adjacent pair is popped from a heap
and merged in a linked list, until no pair has a rank. The count is the number of bytes less the number of merges; no
identifiers are made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: White space by Unicode, and the pre-token pattern that the vocabulary was made with.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Entries that a Python worker remembers, and the longest of them.
REMEMBER, LONGEST = 300_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for themselves, the others for
    the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """Counts tokens of pre-tokens by the ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in vocabulary["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in vocabulary["added_tokens"]]
        self.letters = byte_letters()
        self.pretokens = regex.compile(PRETOKEN).findall

    def of_pretoken(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode()]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
        heapify(heap)
        merged = 0
        while heap:
            _, i, (a, b) = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            merged += 1
            if k < n:
                before[k] = i
                if (r := ranks.get(pair := (symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, pair))
            if (h := before[i]) >= 0 and (r := ranks.get(pair := (symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, pair))
        return n - merged


class Remembered(dict):
    """What make gives for a string, remembered for a bounded number of short strings."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[key] = value
        return value


def stands_apart(text: str) -> bool:
    """Whether pre-tokens never cross a cut of the text before each space.

    A space goes with what follows it if that is no white space, so the parts must not begin or end with any."""
    if not text or text[0] in WHITE or text[-1] in WHITE:
        return False
    # scans of the whole text, as a loop over its parts takes longer
    return not any(white in text and (f" {white}" in text or f"{white} " in text) for white in WHITE)


def apart(text: str) -> list[str] | None:
    """The text cut before each space, without those spaces, if pre-tokens never cross such a cut; else None."""
    return text.split(" ") if stands_apart(text) else None


class Counter:
    """Tokens of whole texts. Special strings in a text are one token each, as the library has it by default."""

    def __init__(self, path: str):
        merger = Merger(path)
        self.pretokens, self.special = merger.pretokens, merger.special
        self.pretoken = Remembered(merger.of_pretoken)
        self.part = Remembered(lambda part: sum(map(self.pretoken.__getitem__, self.pretokens(" " + part))))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        for mark in self.special:
            if mark in text:
                pieces = text.split(mark)
                return len(pieces) - 1 + sum(map(self, pieces))
        parts = apart(text)
        if parts is None:
            return sum(map(self.pretoken.__getitem__, self.pretokens(text)))
        first = sum(map(self.pretoken.__getitem__, self.pretokens(parts[0])))
        return first + sum(map(self.part.__getitem__, parts[1:]))


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path is that of a byte-level vocabulary file (.json), there on every executor. Null and empty texts have 0 bytes
    and tokens. Texts of any length are counted whole. Rows that repeat an id stay. Other columns are not read. No
    shuffle.
    """
    path = path or vocabulary_path()

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(path)
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = bounded_batches(docs).select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
