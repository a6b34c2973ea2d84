"""Periodic runs of words in whole texts, by block matching.

A run is a stretch of words of smallest period q, at least 3 q (and LEAST words) long, that no neighbouring word extends.
For each scale B, a power of two, the text is cut into aligned blocks of B words. A run of period q, B <= q < 2B, holds
an aligned block whose copy q words on lies in the run too, as its words that have a partner fill two blocks. So the
blocks of a scale are the keys of one automaton over word numbers, the whole text is searched with it, and every copy at
a distance of the scale is a seed: both sides are extended word by word while words that far apart agree. The smallest
scale takes all smaller periods as well. What is found is complete, so nothing is sampled or bounded.

Blocks whose first GRAM words never come again at such a distance are no keys. Of a block inside a known run of a period
of at most B, copies inside that run lie whole periods apart and would only give the run again, so the search for them
starts where the run ends.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back, mix64

#: A run has LEAST words and TIMES periods or more. Blocks of the smallest scale have GRAM words.
LEAST, TIMES, GRAM = 24, 3, 8
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def agreeing(x: np.ndarray, a: int, b: int, step: int) -> int:
    """For how many i = 0, 1, ... x[a + step i] equals x[b + step i], within x; b stands beyond a in the direction of step."""
    room = len(x) - b if step > 0 else a + 1
    done, size = 0, 32
    while done < room:
        size = min(2 * size, room - done)
        if step > 0:
            differ = x[a + done : a + done + size] != x[b + done : b + done + size]
        else:
            lo, hi = a - done - size + 1, b - done - size + 1
            differ = (x[lo : lo + size] != x[hi : hi + size])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += size
    return done


class Found:
    """The runs of one text. of[i] is the longest of those that hold word i, or -1."""

    def __init__(self, x: np.ndarray):
        self.x, self.period, self.runs = x, {}, []
        self.of, self.longest = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)

    def holds(self, start: int, end: int, distance: int) -> bool:
        """Whether words from start to end lie in a known run of which the distance is a whole number of periods."""
        k = self.of[start]
        return k >= 0 and self.runs[k][0] <= start and end <= self.runs[k][1] and distance % self.runs[k][2] == 0

    def seed(self, start: int, size: int, distance: int) -> None:
        """The stretch in which words a distance apart agree, around a block and its copy."""
        if self.holds(start, start + distance + size, distance):
            return
        x = self.x
        hi = start + distance + size + agreeing(x, start + size, start + size + distance, 1)
        lo = start - (agreeing(x, start - 1, start - 1 + distance, -1) if start else 0)
        if hi - lo < max(LEAST, TIMES * distance) or self.period.get((lo, hi), distance + 1) <= distance:
            return
        self.period[lo, hi] = distance
        self.runs.append((lo, hi, distance))
        longer = self.longest[lo:hi] < hi - lo
        self.longest[lo:hi][longer] = hi - lo
        self.of[lo:hi][longer] = len(self.runs) - 1


def again(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of GRAM words that stand more than once (by a hash, so perhaps of some others too): their groups, ordered
    by group and place, and for each place of the text its group, or -1."""
    n = len(x) - GRAM + 1
    word, code = mix64(x.astype(np.uint64)), np.zeros(n, np.uint64)
    for j in range(GRAM):
        code = code * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n]
    order = np.argsort(code, kind="stable")
    fresh = np.concatenate([[True], np.diff(code[order]) != 0])
    group = np.cumsum(fresh) - 1
    common = np.bincount(group)[group] > 1
    group_of = np.full(n, -1, np.int64)
    group_of[order[common]] = group[common]
    return group[common], order[common], group_of


def joined(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that intervals cover together."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
    return list(zip(lo[fresh].tolist(), hi[np.concatenate([fresh[1:], [True]])].tolist()))


def periodic_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text of word numbers, by start, then period."""
    n = len(x)
    if n < LEAST:
        return []
    group, place, group_of = again(x)
    if not len(place):
        return []
    keys = group * (n + 1) + place
    found, text, size = Found(x), tuple(x.tolist()), GRAM
    while TIMES * size <= n or size == GRAM:
        near = 1 if size == GRAM else size
        starts = np.arange(0, n - size + 1, size)
        starts = starts[group_of[starts] >= 0]
        # the first place of the same words at this distance or more, if it is not too far
        at = np.searchsorted(keys, group_of[starts] * (n + 1) + np.minimum(starts + near, n))
        starts = starts[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < group_of[starts] * (n + 1) + np.minimum(starts + 2 * size, n))]
        first, last = starts + near, np.minimum(starts + 3 * size, n)
        if len(starts) and found.runs:
            begin, end, period = np.array([*found.runs, (0, 0, 1)]).T
            k = found.of[starts]
            known = (k >= 0) & (begin[k] <= starts) & (starts + size <= end[k]) & (period[k] <= size)
            first = np.where(known, np.maximum(first, end[k] - size + 1), first)
            some = first + size <= last
            starts, first, last = starts[some], first[some], last[some]
        blocks: dict[tuple[int, ...], list[int]] = {}
        for s in starts.tolist():
            blocks.setdefault(text[s : s + size], []).append(s)
        if blocks:
            search = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, of in blocks.items():
                search.add_word(block, of)
            search.make_automaton()
            for lo, hi in joined(first, last):
                for end, of in search.iter(text[lo:hi]):
                    copy = lo + end - size + 1
                    for s in of[bisect_right(of, copy - 2 * size) : bisect_left(of, copy - near + 1)]:
                        found.seed(s, size, copy - s)
        size *= 2
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.period.items())


def planted(words: list[bytes], seed: int | None) -> list[bytes]:
    """The words of a text, of one in ten from some word on with a period. The seed is the crc32 of the id; null changes nothing."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def digest(words: list[bytes]) -> tuple:
    """Number of runs, the run of greatest exponent, and hashes of all runs and of the words that stay."""
    runs = periodic_runs(numbered(words)) if len(words) >= LEAST else []
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, q in runs:
            stays[start + q : start + length] = False
        kept = [words[i] for i in np.flatnonzero(stays)]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *shown, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_runs, the run of greatest length / period (start, length, period,
    exponent_milli; null if there is none), runs_sha256 (all runs) and collapsed_sha256 (the words that stay once every
    run keeps only its first period).

    Words are what stands between ASCII white space. plant first makes one text in ten periodic from some word on, by
    its id (a test of the search on long periods). Null and empty texts have no words and no runs; a null id plants
    nothing; rows that repeat an id or a text stay; an empty table gives none; other columns are not read. A text of any
    length is searched whole, in one task, with memory linear in its words. No shuffle.
    """

    @F.pandas_udf(RESULT)
    def runs_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for seeds, texts in batches:
            rows = [digest(planted(t.encode().split(), None if pd.isna(s) else int(s))) for s, t in zip(seeds, texts)]
            out = pd.DataFrame(rows, columns=RESULT.names)
            yield out.astype({f.name: "Int64" for f in RESULT.fields if isinstance(f.dataType, T.LongType)})
        give_back()

    seed = F.crc32(F.col(id_col).cast("string").cast("binary")) if plant else F.lit(None).cast("long")
    found = bounded_batches(docs).select(F.col(id_col), runs_of(seed, F.coalesce(F.col(text_col), F.lit(""))).alias("_found"))
    return found.select(id_col, *[F.col(f"_found.{c}").alias(c) for c in RESULT.names])
