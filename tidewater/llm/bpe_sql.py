"""Byte-level BPE encoding and decoding by recursive SQL in each task.

A task opens one DuckDB connection of one thread and loads the rank file into it: the vocabulary (id, bytes) and the
merge table (left, right, merged), which holds every split of a token into two tokens. Texts are cut into words by the
pattern of the vocabulary; words that the task does not remember go to a recursive query over rows (word, place,
token): each turn joins neighbours with the merge table and contracts the leftmost pair of lowest rank of each word,
until no word has a pair. Where no pair that the new token can enter has a lower rank, all places of that pair are
contracted in the same turn, from the left, as they would come next in any case. Decoding is an ordered aggregation over rows
(text, place, id) joined with the vocabulary.

Long words are cut first where two bytes meet that no token holds side by side: nothing merges across such a place.
A query runs a bounded number of turns, and words that are not through are taken up by the next one, so the rows of all
turns stay bounded too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LONGEST, vocabulary_path
from .common import bounded_batches, give_back

#: Words that a task remembers before it starts anew (words met since then come back from what it had), words of texts taken at once, bytes of words in one query, rows of all its turns, and
#: bytes from which a word is cut.
REMEMBER, MATCHES, BYTES, ROWS, CUT = 500_000, 400_000, 1 << 19, 1 << 24, 64

_MERGES = """
CREATE TABLE merges AS
SELECT l.id AS first, r.id AS second, m.id AS merged
FROM (SELECT id, hex, unnest(range(2, len(hex), 2)) AS at FROM vocabulary) m
JOIN vocabulary l ON l.hex = left(m.hex, m.at) JOIN vocabulary r ON r.hex = substr(m.hex, m.at + 1)
"""
#: Tokens that no pair of lower rank can take up: all places of a pair that makes one can be contracted in one turn.
_CALM = """
CREATE TABLE merge AS SELECT *, merged NOT IN (SELECT greatest(first, second) FROM merges WHERE merged < greatest(first, second)) AS calm, (SELECT len(hex) // 2 FROM vocabulary WHERE id = merged) AS size FROM merges
"""
#: Of each word the places of its lowest pair: of a stretch that overlaps, every second one; of a token that is not calm, the first.
#: Places are byte offsets, so within such a stretch every second place is a whole number of new tokens from its start.
_ENCODE = """
WITH RECURSIVE turns AS (
  SELECT word, place, following, token, 0 AS turn FROM start
  UNION ALL
  (WITH now AS MATERIALIZED (SELECT * FROM turns WHERE turn < $turns),
  pairs AS MATERIALIZED (
    SELECT a.word, a.place, a.following AS gone, b.following, m.merged, m.calm, m.size
    FROM now a JOIN now b ON b.place = a.following JOIN merge m ON m.first = a.token AND m.second = b.token),
  lowest AS (SELECT word, min(merged) AS merged, min_by(place, merged::BIGINT * 4294967296 + place) AS place FROM pairs GROUP BY word),
  best AS (SELECT p.*, p.place = l.place AS leftmost FROM pairs p JOIN lowest l ON l.word = p.word AND l.merged = p.merged WHERE p.calm OR p.place = l.place),
  taken AS MATERIALIZED (
    SELECT word, place, gone, following, merged FROM best WHERE leftmost UNION ALL
    SELECT word, place, gone, following, merged FROM (
      SELECT *, max(CASE WHEN before IS DISTINCT FROM place THEN place END) OVER (PARTITION BY word ORDER BY place) AS first_place
      FROM (SELECT *, lag(gone) OVER (PARTITION BY word ORDER BY place) AS before FROM best WHERE word IN (SELECT word FROM best WHERE NOT leftmost))
    ) WHERE NOT leftmost AND (place - first_place) % size = 0)
  SELECT n.word, n.place, CASE WHEN t.place IS NULL THEN n.following ELSE t.following END, coalesce(t.merged, n.token), n.turn + 1
  FROM now n SEMI JOIN lowest l ON l.word = n.word LEFT JOIN taken t ON t.place = n.place ANTI JOIN taken g ON g.gone = n.place)
)
SELECT word, place, token, turn = $turns AS open FROM turns SEMI JOIN (SELECT word, max(turn) AS turn FROM turns GROUP BY word) z USING (word, turn)
"""
_DECODE = "SELECT text, array_to_string(list(letters ORDER BY place), '') AS letters FROM tokens JOIN vocabulary USING (id) GROUP BY text"


class Codec:
    """Encodes and decodes by the ranks of a file (base64 bytes and rank in each line)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        held = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [b.hex() for b in ranks], "letters": [b.decode("latin-1") for b in ranks]})
        self.db.register("held", held)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM held")
        self.db.execute(_MERGES)
        self.db.execute(_CALM)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.decimal = np.array([*map(str, range(max(ranks.values()) + 1))], object)
        self.whole = {b: np.int32(k).tobytes() for b, k in ranks.items()}
        self.beside = np.zeros((256, 256), bool)
        for b in ranks:
            if len(b) > 1:
                self.beside[np.frombuffer(b[:-1], np.uint8), np.frombuffer(b[1:], np.uint8)] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, word: bytes) -> list[bytes]:
        """The parts of a long word that merges cannot join."""
        x = np.frombuffer(word, np.uint8)
        ends = [0, *(np.flatnonzero(~self.beside[x[:-1], x[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:])]

    def _contract(self, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Tokens (as bytes of 32-bit integers) of words of so many bytes each, which stand one after the other, as the
        recursive query leaves them."""
        places, words = np.arange(len(tokens)), np.repeat(np.arange(len(sizes)), sizes)
        through: list[tuple[np.ndarray, ...]] = []
        while len(tokens):
            following = pa.array(np.append(places[1:], 0), mask=np.append(words[1:] != words[:-1], True))
            self.db.register("start", pa.table({"word": words, "place": places, "following": following, "token": tokens}))
            rows = self.db.execute(_ENCODE, {"turns": int(np.clip(ROWS // len(tokens), 4, 64))}).fetchnumpy()
            self.db.unregister("start")
            order = np.argsort(rows["place"])  # words stand one after the other
            unfinished = rows["open"][order]
            words, places, tokens = (rows[c][order] for c in ("word", "place", "token"))
            through.append((words[~unfinished], places[~unfinished], tokens[~unfinished]))
            words, places, tokens = words[unfinished], places[unfinished], tokens[unfinished]
        words, places, tokens = (np.concatenate(x) for x in zip(*through))
        order = np.argsort(places)
        ends = np.cumsum(np.bincount(words, minlength=len(sizes))) * 4
        coded = tokens[order].astype(np.int32).tobytes()
        return [coded[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def words(self, words: set[str]) -> dict[str, bytes]:
        """Tokens of each word: itself if it is a token, else what the recursive query makes of it."""
        out: dict[str, bytes] = {}
        cut: dict[str, list[bytes]] = {}
        short: list[str] = []
        for word in words:
            b = word.encode()
            if (whole := self.whole.get(b)) is not None:
                out[word] = whole
            elif len(b) < CUT:
                short.append(word)
            else:
                cut[word] = self._pieces(b)
        distinct = list({p: None for ps in cut.values() for p in ps} | {w.encode(): None for w in short})
        coded: dict[bytes, bytes] = {}
        ends = np.cumsum([len(p) for p in distinct])
        at = 0
        while at < len(distinct):  # some bytes at a time
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES)) + 1
            now, at = distinct[at:upto], upto
            tokens = self.of_byte[np.frombuffer(b"".join(now), np.uint8)]
            coded.update(zip(now, self._contract(tokens, np.array([len(p) for p in now]))))
        out |= {word: coded[word.encode()] for word in short}
        return out | {word: b"".join(map(coded.__getitem__, ps)) for word, ps in cut.items()}

    def encode(self, words: list[list[str]]) -> list[np.ndarray]:
        """Tokens of texts that are given as their words. Short words are remembered."""
        young, old = self.young, self.old
        missing = set().union(*words).difference(young)
        back = missing.intersection(old)
        young |= {w: old[w] for w in back}
        fresh = self.words(missing - back)
        young |= fresh
        out = [np.frombuffer(b"".join(map(young.__getitem__, ws)), np.int32) for ws in words]
        for word in fresh:
            if len(word) > LONGEST:
                del young[word]
        if len(young) > REMEMBER:
            self.old, self.young = young, {}
        return out

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """Bytes of texts that are given as their tokens."""
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return [b""] * len(texts)
        ids = np.concatenate(texts)
        self.db.register("tokens", pa.table({"text": np.repeat(np.arange(len(texts)), sizes), "place": np.arange(len(ids)), "id": ids}))
        found = self.db.execute(_DECODE).fetchnumpy()
        self.db.unregister("tokens")
        letters = dict(zip(found["text"].tolist(), found["letters"]))
        return [letters.get(k, "").encode("latin-1") for k in range(len(texts))]

    def parts(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """Words of texts with the numbers of their texts, a bounded number of words at a time."""
        part, n = [], 0
        for k, text in enumerate(texts):
            matches = self.split.finditer(text) if len(text) > MATCHES else None
            words = self.split.findall(text) if matches is None else [m.group() for m in islice(matches, MATCHES)]
            while True:
                part.append((k, words))
                n += len(words)
                if n >= MATCHES:
                    yield part
                    part, n = [], 0
                words = [m.group() for m in islice(matches, MATCHES)] if matches is not None and words else []
                if not words:
                    break
        if part:
            yield part


@lru_cache(1)
def _codec(path: str) -> Codec:
    return Codec(path)


ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids (the tokens of the whole text, without special ones).

    path is that of a rank file, there on every executor. Null and empty texts have no tokens. Special strings are
    ordinary text. Rows that repeat an id or a text stay; an empty table gives none; other columns are not read. Texts of
    any length are encoded whole, some hundred thousand words at a time. No shuffle.
    """
    path = path or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf(ENCODED)
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path)
        for texts in batches:
            ids: list[list[np.ndarray]] = [[np.array([], np.int32)] for _ in texts]
            for part in codec.parts(texts.tolist()):
                for (k, _), tokens in zip(part, codec.encode([words for _, words in part])):
                    ids[k].append(tokens)
            yield pd.DataFrame({"n_tokens": [sum(map(len, t)) for t in ids], "ids": [np.concatenate(t) for t in ids]})
        give_back()

    out = bounded_batches(docs).select(F.col(id_col), ids_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_coded"))
    return out.select(id_col, "_coded.n_tokens", "_coded.ids")


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of coded: id, decoded (bytes of the tokens, as binary). Null and empty arrays give no bytes;
    an id that the vocabulary has not, or a null one, stands for none."""
    path = path or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path)
        for ids in batches:
            yield pd.Series(codec.decode([np.asarray(t, np.int32) for t in ids]))
        give_back()

    ids = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i.isNotNull())
    return bounded_batches(coded).select(F.col(id_col), bytes_of(ids).alias("decoded"))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, and the sha256 of its tokens (in decimal, joined by commas) and of the
    bytes that they decode to. Encodes and decodes as encode and decode do, with the same treatment of every case, but
    keeps neither tokens nor bytes of a whole text."""
    path = path or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf(ROUND_TRIP)
    def digests_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path)
        for texts in batches:
            counts, ids, decoded = [0] * len(texts), [sha256() for _ in texts], [sha256() for _ in texts]
            for part in codec.parts(texts.tolist()):
                coded = codec.encode([words for _, words in part])
                for (k, _), tokens, back in zip(part, coded, codec.decode(coded)):
                    if len(tokens):
                        ids[k].update(("," if counts[k] else "").encode() + ",".join(codec.decimal[tokens]).encode())
                        decoded[k].update(back)
                        counts[k] += len(tokens)
            yield pd.DataFrame({"n_tokens": counts, "ids_sha256": [h.hexdigest() for h in ids], "decoded_sha256": [h.hexdigest() for h in decoded]})
        give_back()

    out = bounded_batches(docs).select(F.col(id_col), digests_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_done"))
    return out.select(id_col, *[F.col(f"_done.{c}").alias(c) for c in ROUND_TRIP.names])
