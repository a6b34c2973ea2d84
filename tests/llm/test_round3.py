"""Parts of texts that the tokenizer gets, and joins of near-duplicates within large groups."""

import itertools
import random

import numpy as np

from tidewater.llm import near_dup
from tidewater.llm.bpe import stands_apart, vocabulary_path
from tidewater.llm.near_dup import document_frequencies, idf_of, near_duplicates, shingles, similarities
from tidewater.llm.packing import Encoder

from .helpers import table


def crowd(n: int) -> list[str]:
    """n texts of a common beginning, one of two passages and words of their own, none of them alike; then copies of some
    with a word changed."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    base, *passages = [[word() for _ in range(k)] for k in (60, 25, 25)]
    texts = [base + passages[i % 2] + [word() for _ in range(15)] for i in range(n)]
    return [" ".join(t) for t in texts + [[*t[:-1], word()] for t in texts[:12]]]


def largest_join_on_shingles(spark, after: int) -> int:
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        if (k := runs.apply(i).executionId()) > after:
            nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
            for node in map(nodes.apply, range(nodes.size())):
                if "Join" in node.name() and ", e#" in node.desc():
                    for m in map(node.metrics().apply, range(node.metrics().size())):
                        if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                            most = max(most, int(v.get().replace(",", "")))
    return most


def test_a_crowd_that_shares_a_passage_beyond_the_leader(spark):
    """Every two of them were a row of a join, for each shingle of the passage."""
    texts = crowd(200)
    docs = table(spark, texts).cache()
    docs.count()
    store = spark._jsparkSession.sharedState().statusStore()
    after, asked, plain = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1), [], near_dup.unmet

    def unmet(*args):
        out = plain(*args)
        asked.append(out[1].count() if isinstance(out, tuple) else 0)
        return out

    near_dup.unmet = unmet
    try:
        rows = near_duplicates(docs).collect()
    finally:
        near_dup.unmet = plain
    assert largest_join_on_shingles(spark, after) < 60_000
    assert len(asked) > 1 and asked[0] > 0 and asked[-1] == 0
    idf = idf_of(*document_frequencies(docs.selectExpr("text as _t")))
    sets = [shingles([t])[:2] for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if max(similarities(sets[i], sets[j], idf)) >= 0.8 - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    whole, got = {}, {}
    for i, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
        whole.setdefault(find(i), set()).add(i)
        got.setdefault(r.class_md5, set()).add(i)
    assert sorted(map(sorted, whole.values())) == sorted(map(sorted, got.values())) and 12 <= sum(len(c) > 1 for c in got.values())


def test_new_parts_are_encoded_many_at_once():
    r = random.Random(4)
    encode, given = Encoder(vocabulary_path()), []
    plain = encode.encode
    encode.encode = lambda texts: given.extend(texts) or plain(texts)
    words = ["".join(r.choices("abcdefgh", k=9)) for _ in range(2_000)]
    text = " ".join(words)
    ids = [i for (e,) in [encode.library.encode_batch_fast([text], add_special_tokens=False)] for i in e.ids]
    assert np.frombuffer(next(iter(encode([text]))), "<u4").tolist() == ids and len(given) <= 60  # each word by itself before
    assert np.frombuffer(next(iter(encode([text]))), "<u4").tolist() == ids and len(given) <= 61  # and remembered


def test_ids_of_odd_texts_are_those_of_the_library():
    r = random.Random(3)
    signs = [" ", " ", "a", "\n", "\x85", " ", "é", ".", "漢", "１", "\t", "'s", "🙂", "c", "\x00", "<|endoftext|>", "w" * 60]
    texts = ["".join(r.choices(signs, k=r.randint(0, 9))) for _ in range(5_000)] + [""]
    encode = Encoder(vocabulary_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [e.ids for e in encode.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert 0 < sum(map(stands_apart, texts)) < len(texts)
    assert list(encode([])) == [] and list(encode(["", " "])) == [b"", *encode.encode([" "])]
