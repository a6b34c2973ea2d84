"""Benchmark decontamination: prefix-filtered set join of documents with windows of benchmark items. DataFrame operations only.

A window is `size` consecutive words of an item (the whole item, if it is shorter). It is a set of shingles, pairs of
neighbouring words, that must all be present, so a prefix of one shingle is enough: the rarest. A pair is at most as
frequent as its rarer word, its anchor; the words of the benchmark are counted over the whole corpus, and pairs are
ordered by that. Documents are joined with windows on the rarest pair, looking only at places of anchors. The pair's
place in the window gives the place where the window would start (positional bound) and end (length bound), and only
there the words are compared one by one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

#: Windows that are broadcast at once; a larger benchmark is joined part by part.
WINDOWS_AT_ONCE = 20_000


def benchmark_windows(benchmark: DataFrame, size: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: win, its items, and its shingles with their places."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    each = items.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.expr(f"slice(w, at + 1, {size})").alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _rarest_pairs(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, items, side, anchor, o, h): the rarest pair of each window. The anchor is its first word (side 0), its
    second (1), or the only word of the window (2), and stands at word o of the window."""
    each = windows.select("win", "items", F.posexplode("win").alias("o", "anchor")).join(F.broadcast(counts), F.col("anchor") == F.col("word"))
    # a window with a word that no document has occurs in none
    best = each.groupBy("win", "items").agg(F.min(F.struct("n", "o", "anchor")).alias("x"), F.count("*").alias("known")).where("known = size(win)")
    best = best.select("win", "items", "x.o", "x.anchor").withColumn("side", F.expr("case when size(win) = 1 then 2 when o + 1 < size(win) then 0 else 1 end"))
    pair = F.expr("case side when 0 then xxhash64(0, anchor, win[o + 1]) when 1 then xxhash64(1, win[o - 1], anchor) else xxhash64(2, anchor) end")
    return best.withColumn("h", pair)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, and text_hash (xxhash64).

    A word is hit if it stands in any occurrence of a window. contaminated: at least one word in twenty is hit. Null
    and empty texts have no words; an item without words hits nothing. Items that repeat an id or a text count once;
    an item of null id hits words, but is not counted or named. Texts of any length are read whole, in time that grows
    with their length. Rows that repeat an id are looked at on their own; overlapping windows hit a word once.
    Other columns are not read. An empty benchmark hits nothing; an empty table of documents gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h"), words(F.col(text_col)).alias("_w"))
    windows = benchmark_windows(benchmark, size, item_col, item_text_col).cache()
    parts = max(1, math.ceil(windows.count() / WINDOWS_AT_ONCE))
    found = [_occurrences(texts, windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == k), size, first=k == 0) for k in range(parts)]
    hits = reduce(DataFrame.unionByName, found)
    spans = hits.groupBy("_id", "_h").agg(
        F.count_if("itself").alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr("aggregate(spans, named_struct('n', 0, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)")
    out = spans.withColumn("n_hit", covered.cast("long"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("_h").alias("text_hash"),
        F.explode(F.expr("array_repeat(0, int(copies))")).alias("_copy"),
    ).drop("_copy")


def _occurrences(texts: DataFrame, windows: DataFrame, size: int, first: bool) -> DataFrame:
    """(_id, _h, n, itself, s, e, items): occurrences of windows from word s to before word e, and, at first, a row
    for each document itself."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = texts.select(F.explode("_w").alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    pairs = _rarest_pairs(windows, counts).cache()
    anchors = [r[0] for r in pairs.select("anchor").distinct().collect()]  # at most one for each window
    places = F.filter(F.transform("_w", lambda w, p: F.struct(w.alias("t"), p.alias("p"))), lambda x: x.t.isin(anchors))
    # a place carries the words around it, never the whole text
    places = F.transform(places, lambda x: F.struct(x.t.alias("t"), x.p.alias("p"), F.slice("_w", F.greatest(x.p - size, F.lit(0)) + 1, 2 * size + 1).alias("w")))
    if first:
        places = F.concat(F.expr("array(named_struct('t', string(null), 'p', int(null), 'w', cast(array() as array<string>)))"), places)
    at = texts.select("_id", "_h", F.size("_w").alias("n"), F.explode(places).alias("x")).select("_id", "_h", "n", "x.p", "x.t", "x.w")
    at = at.withColumn("_from", F.greatest(F.col("p") - size, F.lit(0)))  # the word that w begins with
    keys = F.when(F.col("p").isNotNull(), F.expr("array(xxhash64(0, t, get(w, p - _from + 1)), xxhash64(1, get(w, p - _from - 1), t), xxhash64(2, t))"))
    at = at.withColumn("h", F.explode_outer(keys)).join(F.broadcast(pairs.select("h", "o", "win", "items")), "h", "left").withColumn("s", F.expr("p - o"))
    fits = F.expr("s >= 0 and s + size(win) <= n") & F.expr("slice(w, s - _from + 1, size(win)) = win")  # position, length, words
    return at.where(F.col("p").isNull() | fits).select("_id", "_h", "n", F.col("p").isNull().alias("itself"), "s", F.expr("s + size(win)").alias("e"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; nulls, ties, repeated rows and empty tables
    are as decontaminate has them."""
    bad_id, bad_hash = fresh(docs, "_bad_id"), fresh(docs, "_bad_hash")
    bad = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select(F.col(id_col).alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    same = docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
