import math
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import lm_score as lm


def brute(rows, train, order, mu, kappa):
    """rows: (id, text); the automaton spelled out with dictionaries."""
    toks = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for _, t in rows]
    c = Counter(tuple(t[i : i + k]) for t, own in zip(toks, train) if own for k in range(1, order + 1) for i in range(len(t) - k + 1))
    n = sum(v for g, v in c.items() if len(g) == 1)
    v = sum(1 for g in c if len(g) == 1)
    out = []
    for t in toks:
        base = score = 0.0
        for i, w in enumerate(t):
            p = (c[(w,)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if i >= k - 1 and (h := c[tuple(t[i - k + 1 : i])]):
                    p = ((1 - kappa) * c[tuple(t[i - k + 1 : i + 1])] + (mu + kappa * h) * p) / (h + mu)
            score += math.log10(p)
        out.append((len(t), sum(c[(w,)] > 0 for w in t), n, base, score))
    return out


TEXTS = ["The cat sat on the mat", "the CAT sat\ton\x0bthe mat", "", None, "a dog É é", "unseen words here", "the cat sat on", "x " * 3000, "the cat sat on the mat", "  "]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force_over_several_blocks(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 120)
    monkeypatch.setattr(lm, "UNIT_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 900)
    monkeypatch.setattr(lm, "PIECE", 7)
    rows = list(enumerate(TEXTS * 2))
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    assert not all(train)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, block string, k int")
    got = lm.score_texts(docs, train=~lm.held_out("doc_id"), order=order, mu=3.0, kappa=0.25).orderBy("id").collect()
    for r, want in zip(got, brute(rows, train, order, 3.0, 0.25), strict=True):
        assert tuple(r)[1:4] == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-12) and r["score"] == pytest.approx(want[4], rel=1e-12)


def test_probabilities_of_a_state_sum_to_one():
    rows = [(0, "a b a c a b"), (1, "b a")]
    end = math.log10(brute([(9, "")], [False], 1, 1, 0)[0][2] or 1)
    assert end == 0.0
    total, train = 0.0, [True, True, False]
    for w in ["a b", "a a", "a c", "a zz", "a"]:
        r = brute([*rows, (2, w)], train, 2, 2.0, 0.3)[2]
        p_a = 4.5 / (10 + 2.5)
        p = 10 ** r[4] / p_a
        if w != "a":  # without the end after the second word
            h = {"b": 3, "a": 4, "c": 1, "zz": 0}[w[2:]]
            c = {"b": 1, "a": 1, "c": 0, "zz": 0}[w[2:]]
            p_end = 2.5 / 12.5
            p /= (0.7 * c + (2 + 0.3 * h) * p_end) / (h + 2) if h else p_end
        total += p
    assert total == pytest.approx(1.0)


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    r = lm.score_texts(df, train=F.lit(None).cast("boolean")).first()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["score"] == r["base_score"] == 0.0
    assert lm.score_texts(df.limit(0)).count() == 0
