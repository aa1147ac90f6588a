"""Operators 11 to 13 against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, lexical_search, simhash
from ledgerloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def plain_fingerprint(text):
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "ÀÉ àé Straße STRASSE", "a b c", "a b c d", "x y z w v\u0085u", "a\x00b c\x1fd e " * 200, prose(random.Random(1), 5000)])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert simhash.shingle_hashes([b"a", b"b", b"c"]).view(np.int64).tolist() == [row["h"]]


def near(r, fp, most):
    for b in r.sample(range(64), r.randrange(most + 1)):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("bucket", [16, 2048])
def test_links_join_what_all_pairs_join(spark, monkeypatch, bucket):
    """Random fingerprints, chains of three differences, dense balls, and buckets that are divided down to a few bits."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    fps = {r.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        x = r.getrandbits(64)
        fps |= {near(r, x, 3) for _ in range(120)}
        for _ in range(20):
            x = near(r, x, 3)
            fps.add(x)
    fps |= {0b1011 << 40 | i for i in range(64)} | {i << 58 for i in range(64)} | {0, 2**64 - 1}
    fps = sorted(fps)
    want = components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    signed = {simhash._signed(x): x for x in fps}
    table = Scratch(spark).keep(spark.createDataFrame([(x,) for x in signed], "fp long"))
    links = [(signed[e["a"]], signed[e["b"]]) for e in simhash.fingerprint_links(table, Scratch(spark)).collect()]
    assert components(fps, links) == want
    assert len(links) < 20 * len(fps)


def test_every_near_pair_has_a_chain():
    r = random.Random(4)
    for _ in range(300):
        a = r.getrandbits(64)
        b = near(r, a, 3)
        found = 0
        for s in range(0, 64, 4):
            x, y = (((v << s) | (v >> (64 - s))) & (2**64 - 1) for v in (a, b))
            found += len(simhash.chain_pairs(np.array([x, y], np.uint64), np.array([0]), np.array([1]))[0])
        assert found > 0


def test_components_of_documents(spark):
    r = random.Random(7)
    base = [prose(r, n) for n in (3, 20, 60, 300, 4000)]
    texts = [None, "", "  ", "one", "One", "two words", *base, *base]
    for b in base[2:]:
        for _ in range(15):
            w = b.split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "alone among all"), (5, base[1]), (5, base[1])]
    got = simhash.simhash_components(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int"))
    fps = [plain_fingerprint(t) for _, t in rows]
    n = range(len(rows))
    root = components(n, [(i, j) for i, j in itertools.combinations(n, 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i in n:
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    want = Counter((rows[i][0], f"{fps[i]:016x}", least.get(root[i])) for i in n)
    assert Counter(map(tuple, got.collect())) == want


def test_simhash_of_no_documents(spark):
    got = simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["id", "fingerprint", "component_id"] and got.count() == 0
    got = simhash.simhash_components(spark.createDataFrame([("b", None), ("a", None)], "doc_id string, text string"))
    assert {tuple(x) for x in got.collect()} == {("a", "0" * 16, "a"), ("b", "0" * 16, "a")}


def plain_search(items, docs, k=10):
    def terms(t):
        return TERM.findall(ascii_lower(t or ""))

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        a, found = Counter(terms(text)), []
        for doc, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in a.items() if t in c)
            if s > 0:
                found.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "HELD", 50)
    monkeypatch.setattr(lexical_search, "PASS_BYTES", 1 << 20 if block > 40 else 500)
    r = random.Random(block)
    docs = [(i, prose(r, r.randrange(1, 60), 60)) for i in range(300)] + [(400 + i, "copy of w1 w2") for i in range(25)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (500, None), (501, ""), (502, "-- !!"), (503, "ÀÉ àé É straße"), (504, prose(r, 20000, 80)), (505, "A1\x00b2\x7fc3`d4")]
    items = [(i, prose(r, r.randrange(1, 30), 90)) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nothing here"), (53, "W1 w1 W1-w2"), (53, "W1 w1 W1-w2"), (53, "another w5"), (None, "àé STRAßE b2"), (54, "É")]
    got = lexical_search.lexical_top(spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int"), spark.createDataFrame([(*x, "a") for x in docs], "doc_id long, text string, item string").repartition(5))
    assert Counter(map(tuple, got.collect())) == plain_search(items, docs)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert lexical_search.lexical_top(one, none).count() == 0
    assert lexical_search.lexical_top(one.limit(0), none.union(spark.createDataFrame([(1, "a")], none.schema))).count() == 0
    # One document that has every term: ln(4 / 3) is above 0.
    assert [tuple(x) for x in lexical_search.lexical_top(one, spark.createDataFrame([("x", "b c")], "doc_id string, text string")).collect()][0][:3] == (1, 1, "x")


def test_length_factors_beyond_64_bits():
    n = np.array([10, 2**40], np.int64)
    assert lexical_search.length_factors(n, 2**30, 2**45).tolist() == [25 + 75 * int(x) * 2**30 // 2**45 for x in n]
    assert lexical_search.length_factors(n[:1], 3, 7).tolist() == [25 + 75 * 30 // 7]


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), np.array(q, "<i4").tobytes(), q) for i, q in kept)
    c = [q for _, _, q in first[:k]]

    def own(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(own(q)[1], []).append(q)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    found = [(i, *own(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def clustered(df):
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return Counter(map(tuple, centroids.cluster_vectors(df).select("id", "cluster", "distance", "cluster_inertia", "inertia", digest).collect()))


def vector(r, at=0.0):
    return [float(np.float32(at + r.gauss(0, 1))) for _ in range(64)]


def test_clusters_equal_brute_force(spark):
    r = random.Random(3)
    hot = vector(r, 1)
    rows = [(i, vector(r, r.choice((-1, 0, 2)))) for i in range(160)] + [(1000 + i, hot) for i in range(90)]
    rows += [(7, rows[0][1]), (7, rows[1][1]), (None, hot), (None, vector(r)), (2000, None), (2001, []), (2002, hot[:63]), (2003, [*hot, 1.0]), (2004, [None, *hot[1:]])]
    rows += [(2005, [float("nan"), *hot[1:]]), (2006, [float("-inf"), *hot[1:]]), (2007, [-0.0] * 64), (2008, [90000.5, *hot[1:]])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, cluster int").repartition(4)
    assert clustered(df) == plain_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(12)], [(i, [float(i)] * 64) for i in range(5)]])
def test_few_vectors(spark, rows):
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == plain_clusters(rows)


def test_large_components_are_held(spark):
    got = centroids.cluster_vectors(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")).collect()
    assert sorted(x["distance"] for x in got) == [0, 0]
