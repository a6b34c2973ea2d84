"""Periodic runs, byte-pair encoding in SQL and centroid clustering against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidewater.llm import bpe_sql, centroids, periodic, queries
from tidewater.llm.bpe import vocabulary_path

from .helpers import DOCS, awkward, prose, table

MULTI = vocabulary_path("byte_bpe_multi_50k.tiktoken")
NONE = hashlib.sha256(b"").hexdigest()


def plain_runs(x):
    """All runs by comparing every word with the one q words on, for each q."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_digest(doc_id, text):
    w = (text or "").encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", w) if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_are_those_of_all_comparisons(letters):
    r = random.Random(letters)
    for _ in range(150):
        x = []
        for _ in range(r.randint(1, 6)):
            unit = [r.randrange(letters) for _ in range(r.randint(1, 40))]
            x += (unit * 14)[: r.randint(1, len(unit) * 6 + 30)] if r.random() < 0.6 else unit
        assert periodic.periodic_runs(np.array(x)) == plain_runs(x)


def test_runs_of_degenerate_texts():
    assert periodic.periodic_runs(np.zeros(200_000, int)) == [(0, 200_000, 1)]
    assert periodic.periodic_runs(np.tile(np.arange(700), 300)) == [(0, 210_000, 700)]
    two = np.concatenate([np.zeros(5000), [1], np.zeros(5000), [2]]).astype(int)
    assert periodic.periodic_runs(two) == [(0, 5000, 1), (5001, 5000, 1)]
    assert periodic.periodic_runs(np.arange(23)) == periodic.periodic_runs(np.array([], int)) == []
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic.periodic_runs(np.array(fibonacci[-1])) == plain_runs(fibonacci[-1])


def test_collapse_runs_of_documents(spark):
    texts = [(i, prose(80, i) + " " + "ha " * (i % 40) + ("one two three " * (i % 12)) + prose(20, i)) for i in range(120)]
    texts += [(None, "x " * 30), (7, None), (8, ""), (9, "a\x0bb\x0cc " * 40), (9, "a\x0bb\x0cc " * 40), (10, "é\xa0ü é\xa0ü " * 20)]
    rows = periodic.collapse_runs(table(spark, texts), plant=True).collect()
    assert sorted(map(str, [(r[0], *r[1:]) for r in rows])) == sorted(map(str, [(i, *plain_digest(i, t)) for i, t in texts]))
    unplanted = {r.doc_id: r.n_runs for r in periodic.collapse_runs(awkward(spark)).collect()}
    assert unplanted == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, None: 0, 6: 0, 7: 0}
    assert periodic.collapse_runs(table(spark, [])).collect() == []


def test_codec_equals_the_library(spark, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "\x00", "<|endoftext|>", "'s", "12", " ", "😀", "ing", "к", "ا", "!!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(300)]
    texts += ["ab" * 1000, "a" * 2000, "日本語" * 300, "".join(r.choice("abcdefgh") for _ in range(500)), "", None, "word " * 30_000]
    expected = [library.encode_ordinary(t or "") for t in texts]
    docs = table(spark, texts)
    coded = bpe_sql.encode(docs)
    assert [list(x.ids) for x in coded.orderBy("doc_id").collect()] == expected
    back = {x.doc_id: bytes(x.decoded) for x in bpe_sql.decode(coded).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for x in bpe_sql.round_trip(docs).collect():
        ids, text = expected[x.doc_id], (texts[x.doc_id] or "").encode()
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    # few turns and bytes in a query, few words at a time, and nothing remembered
    for name, value in (("ROWS", 1), ("BYTES", 50), ("MATCHES", 7), ("REMEMBER", 3)):
        monkeypatch.setattr(bpe_sql, name, value)
    codec = bpe_sql.Codec(MULTI)
    got = [[] for _ in texts[:6]]
    for part in codec.parts(texts[:6]):
        for (k, _), tokens in zip(part, codec.encode([w for _, w in part])):
            got[k] += tokens.tolist()
    assert got == expected[:6]


def test_codec_contracts_one_place_where_a_lower_pair_can_follow(spark, tmp_path, monkeypatch):
    """In a file where a longer token has a lower rank than its part, several places of a pair must not go at once."""
    r = random.Random(4)
    letters = [b"a", b"b", b"c"]
    for _ in range(25):
        longer = {b"".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(14)}
        order = sorted(longer, key=lambda _: r.random())
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + k for k, w in enumerate(order)}
        path = tmp_path / f"{r.random()}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % k for w, k in ranks.items()))
        codec = bpe_sql.Codec(str(path))
        words = {"".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(40)} | {"a" * 25, "ab" * 50}
        for word, coded in codec.words(words).items():
            parts = [bytes([b]) for b in word.encode()]
            while word.encode() not in ranks:
                pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
                if not pairs:
                    break
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            expected = [ranks[word.encode()]] if word.encode() in ranks else [ranks[p] for p in parts]
            assert np.frombuffer(coded, np.int32).tolist() == expected, (word, order)


def test_codec_cases(spark):
    assert bpe_sql.round_trip(table(spark, [])).collect() == []
    rows = bpe_sql.round_trip(awkward(spark)).collect()
    assert len(rows) == 9 and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, NONE, NONE)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 999_999, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe_sql.decode(odd).collect()}.keys() == {1, 2, 3}


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    z = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(z))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        z = [[sum(c) // len(m) for c in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == n]) else old for n, old in enumerate(z)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(z))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted((i, c, d, inertia[c], sum(inertia), name[c]) for i, d, c in found)


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e3])
def test_clusters_equal_plain_rounds(spark, spread, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    r = random.Random(1)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + r.gauss(0, spread) for m in middles[i % 6]]) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(70)] + [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [float("nan")]), (2003, [float("-inf")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int, _vector int")
    assert sorted(tuple(x) for x in centroids.cluster(df).collect()) == plain_clusters(rows)


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    same = [(i, [0.25] * 64) for i in range(40)]
    assert {(r.cluster, r.distance, r.inertia) for r in centroids.cluster(spark.createDataFrame(same, schema)).collect()} == {(0, 0, 0)}
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64)]
    assert sorted(tuple(x) for x in centroids.cluster(spark.createDataFrame(few, schema)).collect()) == plain_clusters(few)
    nameless = spark.createDataFrame([(None, [0.5] * 64), (1, [0.1] * 64)], schema)
    assert {r.vec_id for r in centroids.cluster(nameless).collect()} == {None, 1}
    huge = [(i, [(1e12 + 1e9 * i) * (-1) ** i] * 64) for i in range(20)] + [(20, [1e300] * 64)]
    rows = centroids.cluster(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=2).collect()
    assert len(rows) == 20 and {r.distance for r in rows} == {None}


def test_filtering_resolves_few_vectors_where_clusters_are_apart():
    r = np.random.default_rng(0)
    middles = r.normal(0, 400, (8, 64))
    points = np.floor(middles[r.integers(0, 8, 4000)] + r.normal(0, 5, (4000, 64)))
    tree = centroids.Tree(points)
    owner, counts, sums, resolved = centroids.filtered(tree, np.floor(middles))
    nearest = ((tree.points[:, None] - np.floor(middles)) ** 2).sum(2).argmin(1)
    assert (owner == nearest).all() and resolved < 1200
    assert (counts == np.bincount(nearest, minlength=8)).all() and all((sums[c] == tree.points[nearest == c].sum(0)).all() for c in range(8))


def test_queries_read_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    runs = queries.op11_periodic_runs(spark, d)
    assert runs.count() == n and queries.op12_bpe_round_trip(spark, d).count() == n
    texts = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert sorted(map(str, (tuple(r) for r in runs.collect()))) == sorted(str((t.doc_id, *plain_digest(t.doc_id, t.text))) for t in texts)
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(tuple(x) for x in queries.op13_centroids(spark, d).collect()) == plain_clusters(vectors)
