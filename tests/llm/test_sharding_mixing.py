import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import mixing as mx
from ledgerloom.llm import sharding as sh


def winner(key, weights):
    def bid(s):
        h = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        return weights[s] / -math.log((h + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda s: (bid(s), -s))


def test_shards_slots_and_growth(spark):
    rows = [(i, f"t{i}", "mine") for i in range(400)] + [(None, "n", "x"), (5, "again", "y"), (5, "again", "y"), (7, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SLOT string")
    weights = [1.0, 2.0, 0.0, 1.0]
    got = sh.shard_documents(docs, weights).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == winner(key, weights) != 2
        assert r["grown_shard"] in (r["shard"], 4) and r["grown_shard"] == winner(key, [*weights, 1.0])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots[1]) > 1.4 * len(slots[0])
    assert sh.shard_documents(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        sh.shard_documents(docs, [])


def test_op2_contract(spark, tmp_path):
    texts = ["é", None, "", "abc"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in sh.op2_rendezvous_sharding(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert got[i]["shard"] == winner(str(i), [1.0] * 16)


def mixed(rows, weights, most):
    """Brute force of the targets by resharing, and of the cuts by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(n for n, (*_, x) in zip(size, rows) if x == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(size), {}
    while True:
        free = [s for s in names if s not in capped]
        left, share = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if w[s] * left / share >= most * have[s]]
        if not over:
            break
        capped |= {s: float(most * have[s]) for s in over}
    target = capped | {s: w[s] * left / share for s in free}
    taken = [0] * len(rows)
    for s in names:
        budget = math.floor(target[s] + 1e-9)
        full = budget // have[s] if have[s] else 0
        rest = budget - full * have[s]
        groups = defaultdict(list)
        for i, (d, t, x) in enumerate(rows):
            if x == s:
                groups[hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()].append(i)
        for key in sorted(groups):
            n = sum(size[i] for i in groups[key])
            for i in groups[key]:
                taken[i] = full * size[i] + (size[i] if rest >= n else min(size[i], max(rest, 0) // len(groups[key])))
            rest -= n
    return size, have, target, taken


def fixture():
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 23)), f"s{i % 5}") for i in range(200)]
    return rows + [(1000 + i, "one two three  four\n five", None) for i in range(6)] + [(2000, None, "s1"), (2001, "", "empty"), (3000, "a b c", "s2"), (3000, "a b c", "s2"), (None, "x y z", "S")]


def test_mix_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, taken string")
    size, have, target, taken = mixed(rows, (5, 2, 1), 3)
    got = Counter((r["doc_id"], r["text"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mx.mix(docs).collect())
    assert got == Counter((d, t, s, n, have[s], round(target[s], 6), k) for (d, t, s), n, k in zip(rows, size, taken))
    for s in have:
        assert abs(sum(k for (*_, x), k in zip(rows, taken) if x == s) - target[s]) <= 3
        assert all(k <= 3 * n for n, k in zip(size, taken))


def test_mixed_rows_hold_what_is_taken(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = mx.mixed_rows(docs)
    assert got.columns == docs.columns
    n, out = Counter(), got.collect()
    for r in out:
        assert r["n_chars"] == len(r["text"])
        n[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    want = Counter()
    for (d, *_), k in zip(rows, mixed(rows, (5, 2, 1), 3)[3]):
        want[d] += k
    assert n == +want
    assert mx.mix(docs.limit(0)).count() == 0 and mx.mixed_rows(docs.limit(0)).count() == 0
