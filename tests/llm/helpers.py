"""Documents with the cases that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of river stone lantern copper meadow window silver garden harbor thunder candle orchard velvet marble falcon willow ember canyon".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def table(spark, texts, schema=DOCS):
    """texts: list of texts or (doc_id, text)."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema)


def awkward(spark):
    """Null and empty texts, a very long one, repeated rows, a null id, and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, prose(60, 1)), (4, prose(60, 1)), (5, prose(60, 1)), (None, prose(30, 2)), (6, "...\n\n!!"), (7, "Ünï ÇODÉ x" * 3)]
    clash = [(i, t, "en", "s", 1, 2, 3, 4, "x", 5, 6, 7, 8, "w", "t") for i, t in rows]
    more = ", _id long, n_words long, score long, node string, key long, rep long, _h long, length long, w string, _t string"
    return spark.createDataFrame(clash, DOCS + more)


def collected(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
