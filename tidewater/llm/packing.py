"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. What matters of the pieces is only how many there are of each
length: at most `capacity` numbers, whatever the size of the corpus. Over this histogram the configuration program
(how often to use each way of filling a sequence, so that every length is covered) is solved by multiplicative weights:

* A length's weight starts at its share of all tokens and falls exponentially with the part of it that is covered. Its
  price is its weight over its number of pieces. A knapsack dynamic program finds the configuration of largest price.
* By weak duality the total price over that configuration's price is a lower bound of the number of sequences; the best
  bound of all rounds is kept.
* The same program gives for each length configurations that hold it and come close to the largest price. Each round
  uses these so often that no length gets more than its part of the round; lengths that found none lag behind, and so
  their prices rise.

The sum of the rounds is rounded: configurations are used as often as their whole part, then once more in the order
of their remainders, as long as all their pieces are left, then again while any fits. Only what no configuration of the
program can take is packed best fit.

The plan is then applied on Spark. Pieces are numbered by length within the task that cut them, and a running sum of
the tasks' counts makes these numbers run on; a number gives the sequence and the place in it. Full pieces are
sequences of their own and need no number.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LONGEST, stands_apart, vocabulary_path
from .common import bounded_batches, give_back, settle

#: Parts of texts whose ids a Python worker remembers (about 75 MB). Most parts come once,
#: so they are remembered in two generations, and those that come again pass into the newer one.
REMEMBER = 300_000
#: Pre-tokens that the library remembers (about 20 MB), and new parts that it gets as one text.
PRETOKENS, TOGETHER = 100_000, 50
#: Rounds of multiplicative weights, further rounds for what lags behind at the end, the weights' rate, and the share of
#: the largest price that a configuration needs.
ROUNDS, LAST, RATE, CLOSE = 20, 10, 8.0, 0.99


# --- documents to pieces -------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, as the library gives them. Parts that stand alone between spaces are remembered; new ones are
    encoded many in one text, which the bytes of their tokens take apart again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if resize := getattr(self.library.model, "_resize_cache", None):  # the library's own name for it
            resize(PRETOKENS)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        #: Bytes of each token: a letter of the vocabulary stands for a byte.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # of the generation before

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it. Pre-tokens do not cross the spaces between parts (stands_apart)."""
        ids = b"".join(self.encode([" " + " ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]))
        ends = np.cumsum(self.sizes[np.frombuffer(ids, dtype=np.uint32)])
        wanted = np.cumsum([len(p.encode()) + 1 for p in parts])
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():  # tokens that do not stand for bytes
            return self.encode([" " + p for p in parts])
        stops = (4 * (at + 1)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of each of these different parts, remembered or new."""
        if len(self.known) > REMEMBER // 2:
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, parts))
        missing = [p for p, ids in zip(parts, got) if ids is None]
        found = {p: ids for p in missing if (ids := self.older.get(p)) is not None}
        new = [p for p in missing if p not in found]
        for at in range(0, len(new), 20_000):
            these = new[at : at + 20_000]
            found.update(zip(these, self.encode_parts(these)))
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return [found[p] if ids is None else ids for p, ids in zip(parts, got)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [not any(s in t for s in self.special) and stands_apart(t) for t in texts]
        whole = iter(self.encode([t[: t.find(" ")] if c and " " in t else t for t, c in zip(texts, cut)]))
        split = pc.split_pattern(pa.array([t for t, c in zip(texts, cut) if c], pa.large_string()), pattern=" ")
        words = split.values.dictionary_encode()
        ids = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat, start = np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(size) - size
        word, bounds = words.indices.to_numpy(), split.offsets.to_numpy()
        size, start = size[word], start[word]
        size[bounds[:-1]] = 0  # the first part has no space before it
        end = np.cumsum(size)
        out = flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]
        stops = iter(end[bounds[1:] - 1].tolist())
        at = 0
        for c in cut:
            first = next(whole)
            if c:
                before, at = at, next(stops)
                first += out[before:at].tobytes()
            yield first


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, number) of every piece. Only documents of more than capacity tokens
    (with end_id) are cut, so that all pieces but the first are full. number counts a task's pieces of one length."""
    path = path or vocabulary_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for key, ids in zip(batch["_id"], encode(batch["_t"].tolist())):
                ids += end
                n = len(ids) // 4
                head = n if n <= capacity else n % capacity or capacity
                stops = [head, *range(head + capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip([0, *stops], stops)):
                    rows.append((key, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, seen[b - a]))
                    seen[b - a] += 1
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "task", "number"]).astype({"_id": batch["_id"].dtype})
        encode.known, encode.older = {}, {}
        give_back()

    # ids go as strings: pandas would turn a column of longs with nulls into floats
    texts = bounded_batches(docs).select(F.col(id_col).cast("string").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    out = texts.mapInPandas(run, "_id string, piece int, start long, length long, ids_crc32 long, task int, number long")
    return out.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))


# --- the plan over the histogram -----------------------------------------------------------------------------------


class Knapsack:
    """Unbounded knapsack over lengths 1..capacity (index of worth: length - 1)."""

    def __init__(self, worth: np.ndarray, capacity: int):
        self.sizes = np.flatnonzero(worth > 0) + 1
        self.gain, self.capacity = worth[self.sizes - 1], capacity
        self.best, self.last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
        fits = np.searchsorted(self.sizes, np.arange(capacity + 1), side="right")
        for c in range(1, capacity + 1):
            if k := fits[c]:
                total = self.best[c - self.sizes[:k]] + self.gain[:k]
                j = int(total.argmax())
                self.best[c], self.last[c] = total[j], self.sizes[j]
            if self.best[c] < self.best[c - 1]:
                self.best[c], self.last[c] = self.best[c - 1], 0

    def holding(self, size: int, share: float, open_: np.ndarray) -> list[int]:
        """A configuration that holds size and is worth that share of the best one. It always takes the longest length
        that keeps it so and is open (by length - 1), as short ones fit in anywhere. Empty if there is none."""
        out, room, worth = [size], self.capacity - size, self.gain[np.searchsorted(self.sizes, size)]
        least, some = share * self.best[self.capacity], open_[self.sizes - 1] > 0
        if worth + self.best[room] < least:
            return []
        while room > 0:
            k = int(np.searchsorted(self.sizes, room, side="right"))
            good = some[:k] & (worth + self.gain[:k] + self.best[room - self.sizes[:k]] >= least)
            if not good.any():
                break
            at = np.flatnonzero(good)
            j = int(at[-1])
            out.append(int(self.sizes[j]))
            worth += self.gain[j]
            room -= int(self.sizes[j])
        return out if worth >= least else []


def configurations(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """An approximate solution of the program for these counts (index: length - 1): configurations (lengths, falling)
    and how often each is used; and the best lower bound found. No length gets more than it has; what found no
    configuration close to the best price is left uncovered."""
    sizes, used, bound = np.arange(1, capacity + 1), {}, 0.0
    covered, has = np.zeros(capacity), need > 0
    for turn in range(1, rounds + LAST + 1):
        share = np.divide(covered, need, out=np.zeros(capacity), where=has)
        price = np.where(has, sizes * np.exp(-RATE * (share - share[has].min())), 0.0)
        sack = Knapsack(price, capacity)
        bound = max(bound, float((need * price).sum() / sack.best[capacity]))
        open_ = need * min(1.0, turn / rounds) - covered
        open_[open_ < 1e-9 * need + 1e-12] = 0
        for size in sack.sizes[::-1]:
            while open_[size - 1] > 0 and (held := sack.holding(int(size), CLOSE, open_)):
                each = np.bincount(np.array(held) - 1, minlength=capacity)
                own = each > 0
                times = float((open_[own] / each[own]).min())
                key = tuple(sorted(held, reverse=True))
                used[key] = used.get(key, 0.0) + times
                covered[own] += times * each[own]
                open_[own] = np.where(open_[own] - times * each[own] > 1e-9 * need[own], open_[own] - times * each[own], 0)
    return used, bound


@dataclass
class Plan:
    uses: list[tuple[np.ndarray, int]]  # configuration (index: length - 1), how often
    from_program: int  # sequences that are configurations of the program
    bound: float  # no packing needs fewer

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.uses)


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Plan:
    """A plan that holds exactly the counts (index: length - 1). Full pieces are configurations of one."""
    left = counts.astype(np.int64).copy()
    full, left[capacity - 1] = int(left[capacity - 1]), 0
    uses: list[tuple[np.ndarray, int]] = []
    if full:
        uses.append((_counts([capacity], capacity), full))
    used, bound = configurations(left.astype(float), capacity, rounds) if left.any() else ({}, 0.0)
    times = dict.fromkeys(used, 0)

    def use(key: tuple[int, ...], most: int) -> None:
        a = _counts(key, capacity)
        held = a > 0
        n = min(most, int((left[held] // a[held]).min()))
        if n > 0:
            times[key] += n
            left[held] -= n * a[held]

    for key, x in used.items():
        use(key, int(x))
    for key in sorted(used, key=lambda k: (int(used[k]) - used[k], k)):
        use(key, 1)
    for key in sorted(used, key=lambda k: (-sum(k), k)):
        use(key, int(left.sum()))
    uses += [(_counts(key, capacity), n) for key, n in times.items() if n]
    return Plan(uses + best_fit(left, capacity), full + sum(times.values()), full + bound)


def _counts(lengths, capacity: int) -> np.ndarray:
    return np.bincount(np.array(lengths) - 1, minlength=capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The longest piece left, then the subset of the others that fills the sequence best; as often as they last."""
    left, plan = left.copy(), []
    while left.any():
        a = np.zeros(capacity, dtype=np.int64)
        longest = int(np.flatnonzero(left).max()) + 1
        a[longest - 1] = 1
        for size, n in _fill(left - a, capacity - longest):
            a[size - 1] += n
        held = a > 0
        times = int((left[held] // a[held]).min())
        plan.append((a, times))
        left -= a * times
    return plan


def _fill(left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Lengths, with counts within those left, that fill as much of room as can be (subset sums by bit shifts)."""
    sizes = [int(s) + 1 for s in np.flatnonzero(left[:room] > 0)[::-1]] if room > 0 else []
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for size in sizes:
        n, part = int(min(left[size - 1], room // size)), 1
        while n > 0:  # 1, 2, 4, ... of a length
            part = min(part, n)
            grown = reach | (reach << size * part) & mask
            if grown != reach:
                steps.append((size, part, reach))
                reach = grown
            n -= part
            part *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for size, part, before in reversed(steps):
        if not before >> at & 1:
            at -= size * part
            out.append((size, part))
    return out


# --- the plan applied ----------------------------------------------------------------------------------------------


def _places(plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For runs of pieces of one length, in order: length, first number, pieces in a sequence, first sequence, offset."""
    rows, seen, sequence = [], {}, 0
    for a, times in plan:
        offset = 0
        for size in np.flatnonzero(a)[::-1] + 1:
            each = int(a[size - 1])
            rows.append((size, seen.get(size, 0), each, sequence, offset))
            seen[size] = seen.get(size, 0) + each * times
            offset += int(size) * each
        sequence += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "number", "each", "sequence", "offset"), table.T))


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end token alone. Texts of any length are cut, never shortened. Rows that
    repeat an id are packed each on their own; pieces of equal length are interchangeable, so ties change nothing but
    sequence numbers. Other columns are not read. An empty table gives an empty table. The driver sees the histogram by
    length (capacity numbers at most), never pieces. Full pieces get negative sequence numbers, the others those from 0.
    """
    pieces = settle(cut_pieces(docs, capacity, end_id, path, id_col, text_col))
    groups = pieces.where(F.col("length") < capacity).groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity, dtype=np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():
        counts[length - 1] = n
    at = _places(solve(counts, capacity).uses)
    lo = np.searchsorted(at["length"], np.arange(capacity + 2)) if len(at["length"]) else np.zeros(capacity + 2, dtype=np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(dtype=np.int64), number.to_numpy(dtype=np.int64)
        run = np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            mine = size == s
            run[mine] = lo[s] + np.searchsorted(at["number"][lo[s] : lo[s + 1]], n[mine], side="right") - 1
        sequence, slot = np.divmod(n - at["number"][run], at["each"][run])
        return pd.DataFrame({"sequence_id": at["sequence"][run] + sequence, "offset": at["offset"][run] + slot * size})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = pieces.where(F.col("length") < capacity).join(first, ["length", "task"]).withColumn("at", place("length", F.col("first") + F.col("number")))
    out = [F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*out, (-1 - F.shiftleft(F.col("task").cast("long"), 40) - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*out, "at.sequence_id", "at.offset").unionByName(full)
