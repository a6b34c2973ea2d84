"""License scan, decontamination, near-duplicates and chats against brute force."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from tidewater.llm.chat import format_chats
from tidewater.llm.common import Scratch, words_of
from tidewater.llm.decontaminate import decontaminate, drop_contaminated
from tidewater.llm.license_scan import Template, license_scan
from tidewater.llm.near_dup import components, document_frequencies, idf_of, keep_one, near_duplicates, shingles, similarities

from .helpers import DOCS, awkward, prose, table


def test_license_places_and_labels(spark):
    texts = ["MIT License. mit  license, MIT-License", "mit x license", "the cc by", None, "Licensed under the Apache License, Version 2.0", prose(300, 3) + " GNU general\npublic LICENSE " + prose(5, 4)]
    rows = {r.doc_id: r for r in license_scan(table(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 0, 4, "mit")
    assert (rows[1].n_base, rows[1].first_word, rows[1].base_labels) == (0, None, "")
    assert rows[2].labels == "cc-by" and rows[2].first_word == 1
    assert (rows[3].n_words, rows[3].n_base, rows[3].labels, rows[3].score) == (0, 0, "", 0.0)
    assert rows[4].labels == "apache,apache-notice"
    assert rows[5].first_word == 300 and rows[5].base_labels == "gpl"


def test_license_containment_is_exact(spark):
    template = Template("alpha beta gamma delta epsilon", "five")
    pool = "alpha beta gamma delta epsilon zeta".split()
    texts = [" ".join(p) for p in itertools.islice(itertools.permutations(pool, 4), 0, 360, 7)] + ["filler " * 13 + "delta beta x alpha gamma", "alpha alpha alpha alpha"]
    for r in license_scan(table(spark, texts), (template,)).collect():
        ws = words_of(texts[r.doc_id])
        blocks = [set(ws[a : a + 10]) & set(pool[:5]) for a in range(0, len(ws), 5)]
        best = max((len(b) / 5 for b in blocks), default=0)
        assert (r.labels == "five") == (best >= 0.8) and abs(r.score - (best if best >= 0.8 else 0)) < 1e-6


def test_license_templates_in_parts(spark, monkeypatch):
    from tidewater.llm import license_scan as module

    texts = ["MIT License. apache license", None, prose(40, 1) + " released under the mit license " + prose(9, 2), "released under the the mit license " * 30]
    whole = sorted(license_scan(table(spark, texts)).collect())
    monkeypatch.setattr(module, "TEMPLATES_AT_ONCE", 3)
    assert sorted(license_scan(table(spark, texts)).collect()) == whole and whole[3].n_base == 30 and whole[0].n_base == 2
    assert [r.labels for r in license_scan(table(spark, texts), ()).collect()] == [""] * 4


def test_license_awkward_tables(spark):
    docs = awkward(spark)
    rows = license_scan(docs).collect()
    assert len(rows) == docs.count() and sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert license_scan(table(spark, [])).count() == 0


def brute_contamination(texts, items, size=13):
    wins = {}
    for i, t in items:
        ws = words_of(t)
        for a in range(max(len(ws) - size, 0) + 1):
            if ws:
                wins.setdefault(tuple(ws[a : a + size]), set()).add(str(i))
    out = []
    for i, t in texts:
        ws, hit, found = words_of(t), set(), set()
        for win, who in wins.items():
            for a in range(len(ws) - len(win) + 1):
                if tuple(ws[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found |= who
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out)


def test_decontamination(spark):
    item = prose(30, 7)
    items = [(1, item), (2, item), (10, prose(13, 8)), (11, "solo"), (12, None), (13, ""), (14, "two words"), (15, "a a a a a a a a a a a a a a")]
    texts = [(0, item), (1, prose(400, 9) + " " + item[40:150] + " " + prose(5, 1)), (2, "SOLO"), (3, "two  WORDS two words"), (4, None), (5, ""), (6, prose(200, 5)), (7, "a " * 40), (8, " ".join(words_of(item)[:12])), (9, "x solo " + "y " * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(table(spark, texts), bench).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute_contamination(texts, items)
    left = drop_contaminated(table(spark, texts), bench)
    assert left.columns == table(spark, texts).columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in brute_contamination(texts, items) if not r[5]}


def test_decontamination_in_parts(spark, monkeypatch):
    from tidewater.llm import decontaminate as module

    monkeypatch.setattr(module, "WINDOWS_AT_ONCE", 7)
    items, texts = [(i, prose(20, i)) for i in range(4)], [(9, prose(20, 1) + " z " + prose(20, 3)), (8, "z")]
    got = decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute_contamination(texts, items)


def test_decontamination_awkward_tables(spark):
    docs, bench = awkward(spark), spark.createDataFrame([(1, prose(60, 1), 0)], "item_id long, text string, win int")
    rows = decontaminate(docs, bench).collect()
    assert len(rows) == docs.count() and sum(r.contaminated for r in rows) == 3
    empty = bench.limit(0)
    assert not any(r.contaminated or r.n_hit for r in decontaminate(docs, empty).collect())
    assert decontaminate(table(spark, []), bench).count() == 0


def test_near_duplicates(spark):
    base = [prose(200, s).split() for s in range(6)]
    texts = []
    for s, b in enumerate(base):
        texts.append(" ".join(b))
        for k in range(12 if s == 0 else 2):  # one word in 200 differs
            texts.append(" ".join([*b[: 10 * k + 5], f"new{k}", *b[10 * k + 6 :]]))
    texts += [texts[0], None, "", "", "tiny", "tiny", "tiny text here"]
    rows = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    first = [0, 13, 16, 19, 22, 25]
    for a, b in zip(first, [*first[1:], 28]):
        assert {rows[i].class_id for i in range(a, b)} == {a}
    assert rows[28].class_id == 0 and rows[28].n_copies == 2
    assert {rows[i].class_id for i in (29, 30, 31)} == {29}  # null is empty
    assert rows[32].class_id == rows[33].class_id == 32 and rows[34].class_id == 34
    kept = keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in rows.values()})


def test_near_duplicates_awkward_tables(spark):
    docs = awkward(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, bytes(r.text_md5)): r for r in rows}
    assert {r.class_id for r in rows if r.doc_id in (4, 5)} == {4} and len(by) == docs.count() - 1
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert near_duplicates(table(spark, [])).count() == 0 and keep_one(table(spark, [])).count() == 0


def brute_classes(spark, texts, threshold=0.8):
    """The smallest place of each text's class, from all pairs of unlike texts."""
    n, df = document_frequencies(table(spark, texts).select(F.col("text").alias("_t")))
    own, idf = sorted(set(texts)), idf_of(n, df)
    sets, root = [shingles([t])[:2] for t in own], list(range(len(own)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(own)), 2):
        if max(similarities(sets[i], sets[j], idf)) >= threshold - 1e-9:
            root[top(i)] = top(j)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(top(own.index(t)), i)
    return {i: first[top(own.index(t))] for i, t in enumerate(texts)}


def edited(words, tag, *places):
    return [f"{tag}at{i}" if i in places else w for i, w in enumerate(words)]


def test_near_duplicates_of_a_group_of_a_third(spark):
    hub = prose(100, 1).split()
    # a third of the rows; at its rim two separate words differ (TF similarity 0.81, TF-IDF similarity near 0.57)
    texts = [" ".join(hub)] * 260 + [" ".join(edited(hub, f"new{k}", 20 + k % 20, 60 + k % 20)) for k in range(40)]
    texts += [prose(40, 100 + k) for k in range(600)]
    rows = near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(spark, texts)


def test_near_duplicates_by_way_of_a_member(spark):
    texts = []
    for g in range(8):  # a group that differs in its last words; x lacks these; y lacks the first words too and is like x only
        hub = prose(200, g).split()
        texts += [" ".join(edited(hub, f"new{k}", 180 + k % 20)) for k in range(40)]
        texts += [" ".join(hub[:180]), " ".join(hub[25:180])]
    rows = near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(spark, texts)


def test_near_duplicates_of_edits_of_edits(spark):
    rng, texts = random.Random(5), []
    for g in range(4):  # each an edit of a random earlier one: words replaced, left out or put in
        family = [prose(120, 500 + g).split()]
        for k in range(90):
            w = list(rng.choice(family))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[f"e{rng.randrange(30)}"], [], [w[at], f"i{rng.randrange(30)}"]])
            family.append(w if rng.random() < 0.8 else w[rng.randrange(1, 12) :])
        texts += map(" ".join, family)
    texts += [prose(40, 900 + k) for k in range(150)]
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, texts)).collect()}
    want = brute_classes(spark, texts)
    # bands miss a pair of the threshold with a chance of 0.002; classes hang together by more than one pair
    assert sum(got[i] != want[i] for i in want) <= 3


def test_classes_that_share_an_id_stay_apart(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    docs = table(spark, [(None, a), (None, b), (None, b), (None, c), (7, prose(60, 4)), (7, prose(60, 5)), (8, prose(60, 5)), (9, c)])
    rows = near_duplicates(docs).collect()
    assert len({r.class_md5 for r in rows}) == 5 and len({(r.class_md5, r.class_id) for r in rows}) == 5
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (9, c), (7, prose(60, 4)), (7, prose(60, 5))], key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 6), (7, 8), (8, 9), (9, 10), (10, 11), (20, 20)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a int, b int"), Scratch(spark)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 11: 6}


CHAT = "conv_id long, turn long, role string, text string"


def test_chats(spark):
    hi, yo, bye = ("user", "hi"), ("assistant", "yo"), ("user", "bye")
    logs = {1: [hi], 2: [hi, yo], 3: [hi, yo, bye], 4: [hi, yo, bye], 5: [yo], 6: [hi, bye], 7: [(None, None)], 8: [("user", "h"), ("i", "")]}
    rows = [(c, i, *t) for c, ts in logs.items() for i, t in enumerate(ts)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8]
    assert got[3].rendered == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nbye\n" and got[3].n_turns == 3
    assert got[7].rendered == "<||>\n\n"


def test_chats_awkward_tables(spark):
    rows = [(None, 0, "user", "a", 1), (None, None, "user", "b", 1), (1, 2, "user", "x", 1), (1, 2, "assistant", "x", 1), (1, 2, "assistant", "x", 1)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, CHAT + ", n long")).collect()}
    assert got[None].rendered == "<|user|>\nb\n<|user|>\na\n" and got[1].n_turns == 3
    assert format_chats(spark.createDataFrame([], CHAT)).count() == 0
