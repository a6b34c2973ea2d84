"""Training samples are bounded in rows and fair to every language, whatever ids repeat."""

import random

import pytest

from tidewater.llm.langid import fit_languages
from tidewater.llm.quality import labelled

from .helpers import DOCS

SOUNDS = {"es": "perro gato casa mesa libro ventana camino noche agua".split(), "en": "dog house table book window road night water cat".split()}


def text(lang, r, n=12):
    return " ".join(r.choice(SOUNDS[lang]) for _ in range(n))


@pytest.mark.parametrize("hot", [1, 5, 9, 12])
def test_a_language_on_one_id_is_learned(spark, hot):
    """900 Spanish rows of one id beside 300 English ones of different ids."""
    r = random.Random(hot)
    rows = [(hot, text("es", r), "es", "s", 1) for _ in range(900)] + [(1000 + i, text("en", r), "en", "s", 1) for i in range(300)]
    for docs_each in (50, 300):
        crf = fit_languages(spark.createDataFrame(rows, DOCS), held_out=-1, docs_each=docs_each, words_each=2000)
        assert sorted(crf.labels) == ["en", "es"]


def test_copies_of_one_row_count_once(spark):
    rows = [(1, "perro gato casa", "es", "s", 1)] * 500 + [(i, text("en", random.Random(i)), "en", "s", 1) for i in range(2, 400)]
    assert sorted(fit_languages(spark.createDataFrame(rows, DOCS), held_out=-1, docs_each=20, words_each=500).labels) == ["en", "es"]


def test_labelled_rows_are_bounded(spark):
    r = random.Random(1)
    rows = [(3, text("en", r, 20), "en", "s", 1) for _ in range(1500)] + [(i, text("en", r, 20), "en", "s", 1) for i in range(10, 1500)]
    labels = spark.createDataFrame([(i, i % 2) for i in [3, *range(10, 1500)]], "doc_id long, quality int")
    found = labelled(spark.createDataFrame(rows, DOCS), labels, "quality", 5, -1, 100, "doc_id", "text").collect()
    assert len(found) == 100 and {row.y for row in found} == {0, 1}
    whole = labelled(spark.createDataFrame(rows, DOCS), labels, "quality", 5, -1, 10_000, "doc_id", "text")
    assert whole.count() == 1491
