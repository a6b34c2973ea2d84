"""License scan: exact set-similarity join of text blocks with license templates.

A template is a short text. For a template of L words the text is cut into blocks of 2L words, one every L words, so
that any L consecutive words stand in one block. A block meets a template if it holds at least the share `threshold`
of the template's distinct words (containment).

The join is the prefix-filtered one. Tokens are put in one global order, rarest in the corpus first. If a block holds
o = ceil(threshold * t) of the t tokens of a template, it holds one of the template's first t - o + 1, so only those
prefix tokens are joined with the words of the documents. Of the candidates, those go that are too short (length
filter) or whose tokens after the shared one cannot make up the overlap (positional filter); the rest are counted.

Templates marked base also have their exact places found: all words, consecutively. Such a place lies in a block of
containment 1, so the join loses none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words, words_of


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    base: bool = False


TEMPLATES = (
    Template("gnu general public license", "gpl", True),
    Template("apache license", "apache", True),
    Template("cc by", "cc-by", True),
    Template("mit license", "mit", True),
    Template("licensed under the apache license version 2 0", "apache-notice"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    Template("released under the mit license", "mit-notice"),
    Template("this work is licensed under a creative commons attribution license cc by", "cc-by-notice"),
    Template("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
)
#: Templates that are broadcast at once; more are joined part by part.
TEMPLATES_AT_ONCE = 2000


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base templates, first_word and last_word are their smallest and largest start (words
    from 0). labels are those of base templates found and of other templates met by a block; score is the largest
    containment of any template that a block meets, 0 without one.

    Null and empty texts have no words and no labels. Texts of any length are read whole, in time that grows with their
    length. Rows that repeat an id are looked at on their own; templates of equal share each give their label. Other
    columns of docs are not read. An empty table gives an empty table, and no templates no labels.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h"), words(F.col(text_col)).alias("_w"))
    parts = [templates[a : a + TEMPLATES_AT_ONCE] for a in range(0, len(templates), TEMPLATES_AT_ONCE)] or [()]
    met = reduce(DataFrame.unionByName, [_blocks_met(texts, part, threshold, k * TEMPLATES_AT_ONCE) for k, part in enumerate(parts)])
    labelled = F.size("starts") > 0
    # blocks overlap and rows repeat: sets collapse what is equal before anything is shuffled
    met = met.withColumn("place", F.explode_outer(F.expr("transform(starts, s -> struct(s, k))")))
    found = met.groupBy("_id", "_h").agg(
        F.count_if("itself").alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.collect_set("place").alias("places"),
        F.array_sort(F.collect_set(F.when(labelled, F.col("label")))).alias("_base"),
        F.array_sort(F.collect_set(F.when(~F.col("base") | labelled, F.col("label")))).alias("_all"),
        F.max("share").alias("share"),
    )
    at = F.col("places.s")
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join("_all", ",").alias("labels"),
        F.coalesce(F.round("share", 6), F.lit(0.0)).alias("score"),
        F.explode(F.expr("array_repeat(0, int(copies))")).alias("_copy"),
    ).drop("_copy")


def _blocks_met(texts: DataFrame, templates: tuple[Template, ...], threshold: float, first: int) -> DataFrame:
    """Blocks that meet a template (numbered from first), with starts of a base one's places; in the first part also a
    row for each document itself. A place of a prefix token carries the words around it, never the whole text."""
    split = [(t, words_of(t.text)) for t in templates]
    split = [(t, ws) for t, ws in split if ws]
    vocabulary = sorted({w for _, ws in split for w in ws})
    counts = texts.select(F.explode(F.filter("_w", lambda w: w.isin(vocabulary))).alias("_t")).groupBy("_t").count() if vocabulary else None
    seen = {r[0]: r[1] for r in counts.collect()} if vocabulary else {}  # at most a row for each word of the part's templates
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    prefix, longest = [], max((len(ws) for _, ws in split), default=1)
    for k, (t, ws) in enumerate(split):
        tokens = sorted(set(ws), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            prefix.append((token, first + k, t.label, t.base, ws, tokens, len(ws), need, i))
    prefixes = F.broadcast(texts.sparkSession.createDataFrame(prefix, "_t string, k int, label string, base boolean, phrase array<string>, tokens array<string>, L int, need int, i int"))

    wanted = sorted({row[0] for row in prefix})
    places = F.filter(F.transform("_w", lambda w, p: F.struct(w.alias("t"), p.alias("p"))), lambda x: x.t.isin(wanted))
    around = F.transform(places, lambda x: F.struct(x.t.alias("t"), x.p.alias("p"), F.slice("_w", F.greatest(x.p - 2 * longest, F.lit(0)) + 1, 4 * longest + 1).alias("w")))
    if not first:  # and one row without a place for the document itself
        around = F.concat(F.expr("array(named_struct('t', string(null), 'p', int(null), 'w', cast(array() as array<string>)))"), around)
    hits = texts.select("_id", "_h", F.size("_w").alias("n"), F.explode(around).alias("_x"))
    hits = hits.select("_id", "_h", "n", F.col("_x.t").alias("_t"), F.col("_x.p").alias("p"), F.col("_x.w").alias("_w")).join(prefixes, "_t", "left")
    hits = hits.withColumn("_from", F.greatest(F.col("p") - 2 * longest, F.lit(0)))  # the word that _w begins with
    blocks = hits.select("*", F.explode_outer(F.expr("if(p div L > 0, array(int(p div L * L), int((p div L - 1) * L)), array(int(p div L * L)))")).alias("at"))
    blocks = blocks.withColumn("_b", F.expr("slice(_w, at - _from + 1, 2 * L)"))
    ranked = F.array_intersect(F.array(*map(F.lit, order)), F.col("_b")) if order else F.expr("cast(array() as array<string>)")  # the block's tokens in the global order
    blocks = blocks.withColumn("ranked", ranked).withColumn("j", F.expr("array_position(ranked, _t) - 1"))
    fits = F.expr("least(2 * L, n - at) >= need")  # length
    fits = fits & F.expr("1 + least(size(tokens) - i - 1, size(ranked) - j - 1) >= need")  # position
    blocks = blocks.withColumn("overlap", F.when(fits, F.size(F.array_intersect("tokens", "ranked"))))
    starts = F.expr("""case when base and overlap = size(tokens) and n >= at + L
        then filter(sequence(at, least(at + L - 1, n - L)), s -> slice(_w, s - _from + 1, L) = phrase) end""")
    return blocks.where("_t is null or overlap >= need").select("_id", "_h", "n", "k", "label", "base", F.col("_t").isNull().alias("itself"), (F.col("overlap") / F.size("tokens")).alias("share"), starts.alias("starts"))
