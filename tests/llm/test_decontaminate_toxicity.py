import math
import random
import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as dc
from ledgerloom.llm import toxicity as tx


def corpus():
    r = random.Random(3)
    v = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choices(v, k=n)).capitalize() + ".") for i, n in enumerate([5, 6, 9, 14, 20, 33, 40, 60, 150, 4, 1])]
    docs = []
    for i in range(60):
        w = r.choices(v, k=r.choice([30, 300, 4000]))
        if i % 3 == 0:
            item = items[i // 3 % len(items)][1].split()
            if i % 2:
                item[len(item) // 2 :] = item[len(item) // 2 :][: max(0, len(item) // 2 - 2)]  # a part of it only
            at = r.randrange(len(w))
            w[at:at] = item
        docs.append((i, " ".join(w)))
    # 0.8 exactly and just below, of 20 shingles
    item = items[4][1].split()
    docs += [(100, " ".join(item[: 4 + 13])), (101, " ".join(item[: 4 + 12])), (102, None), (103, ""), (104, "w1 w2"), (100, " ".join(item))]
    return docs, [*items, (4, items[4][1]), (50, None), (51, "")]


def contained(docs, items):
    out = []
    for d, t in docs:
        own = dc.shingles(dc.words_of(t))
        for i, q in dict.fromkeys(items):
            s = dc.shingles(dc.words_of(q))
            if s and len(s & own) >= 0.8 * len(s):
                out.append((d, i, len(s & own), len(s)))
    return sorted(out)


@pytest.mark.parametrize("per_pass", [20000, 3])
def test_hits_equal_brute_force(spark, monkeypatch, per_pass):
    monkeypatch.setattr(dc, "PASS_ITEMS", per_pass)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, item_id long")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:4] for r in dc.find_contained(d, q).collect())
    assert got == contained(docs, items) and len(got) > 8
    hit = {(x, t) for x, t in docs if contained([(x, t)], items)}
    left = dc.drop_contaminated(d, q)
    assert left.columns == d.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted((x, t or "") for x, t in docs if (x, t) not in hit)
    assert dc.find_contained(d.limit(0), q).count() == 0 and dc.find_contained(d, q.limit(0)).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("x", "a b c d e f")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "A, b c d e f!")], "item_id string, text string")
    assert tuple(dc.find_contained(docs, items).first()) == ("x", "q", 2, 2, 1.0)


@pytest.mark.parametrize("kind, ident", [("smallint", 7), ("decimal(9,2)", Decimal("7.25")), ("date", date(2020, 1, 2)), ("boolean", True), ("binary", bytearray(b"k")), ("double", 2.5), ("int", None)])
def test_ids_of_any_type(spark, kind, ident):
    docs = spark.createDataFrame([(ident, "a b c d e f")], f"doc_id {kind}, text string")
    items = spark.createDataFrame([(ident, "A, b c d e f!")], f"item_id {kind}, text string")
    got = dc.find_contained(docs, items)
    assert got.dtypes[:2] == [("doc_id", kind), ("item_id", kind)]
    assert tuple(got.first()) == (ident, ident, 2, 2, 1.0)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :]


def test_automaton_on_the_trie_equals_edit_distance():
    r = random.Random(1)
    terms = sorted({"".join(r.choices("abc", k=r.randint(3, 7))) for _ in range(60)})
    trie = tx.Trie(terms)
    for _ in range(1500):
        w = "".join(r.choices("abc", k=r.randint(2, 8)))
        want = sorted(t for t in terms if one_edit(w, t))
        assert sorted(trie.within_one(w)) == want


def test_misspelling_and_context():
    m = tx.Model(dict.fromkeys(tx.SEED, 3.0)).matcher()
    assert m["idiot"] == (3.0, False) and m["idiiot"] == (3.0, True) and m["id1ot"] == (3.0, True) and m["table"] is None
    plain, quoted, direct = (m.features(t)[2] for t in ("what an idiot he is", 'the word "idiot" is rude', "you are an idiot"))
    assert quoted < plain < direct
    assert m.features(None) == m.features("") == [0.0, 0.0, 0.0, 0.0, 0.13862943611198905]


def made(spark):
    r = random.Random(2)
    v = [f"wort{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = r.choices(v, k=r.randint(20, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumblox", "idiot", "grumbloxe", "flarp" + r.choice("abcdefg") + "x"]))
        docs.append((i, " ".join(w), "held"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame([*docs, (None, None, ""), (5000, "", "")], "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_learned_model_on_held_out_rows(spark):
    docs, labels = made(spark)
    model = tx.learn(docs, labels)
    got = tx.score_toxicity(docs, model, keep=("doc_id",)).withColumn("held", tx.held_out("doc_id")).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held"] and r["doc_id"] < 600]
    assert len(held) > 100
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] < 0.3 for r in got if r["doc_id"] in (None, 5000))
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["score"] < 0.3)


def test_held_out_labels_are_never_read(spark):
    docs, labels = made(spark)
    turned = labels.withColumn("toxic", F.when(tx.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.learn(docs, labels), tx.learn(docs, turned)
    assert a.terms == b.terms and a.stems == b.stems and a.coef == pytest.approx(b.coef, rel=1e-9)


def test_few_labels_fall_back_to_the_seed(spark):
    docs, labels = made(spark)
    model = tx.learn(docs, labels.limit(0))
    assert set(model.terms) == set(tx.SEED)
    rows = spark.createDataFrame([(1, "you idiot, you pathetic moron"), (2, "good morning to all of you")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.3 for r in tx.score_toxicity(rows, model, keep=("doc_id",)).collect()} == {1: True, 2: False}
    assert tx.score_toxicity(rows.limit(0), model).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_score(model, text):
    """Brute force: every token against every term by the full table, windows by position, the logistic sum spelled out."""
    words = re.findall(r'\w+|["“”„«»]', (text or "").lower())
    exact = fuzzy = best = 0.0
    for i, w in enumerate(words):
        found = [s for t, s in model.terms.items() if t == w] + [s for t, s in model.stems.items() if w.startswith(t)]
        near = not found and len(w) >= 4 and w not in model.known
        if near:
            found = [s for t, s in model.terms.items() if len(t) >= 5 and abs(len(t) - len(w)) <= 1 and levenshtein(t, w) <= 1]
        if not found:
            continue
        before, after = words[max(0, i - 6) : i], words[i + 1 : i + 7]
        weight = max(found)
        if (set(before) & tx.QUOTES and set(after) & tx.QUOTES) or set(before[-3:]) & tx.REPORTING:
            weight *= 0.4
        elif set(before[-4:]) & tx.ADDRESS or set(after[:4]) & tx.ADDRESS:
            weight *= 1.3
        best = max(best, weight)
        exact, fuzzy = (exact, fuzzy + weight) if near else (exact + weight, fuzzy)
    n = max(len(words), 1)
    f = [math.log(1 + exact), math.log(1 + 100 * exact / n), best / 4, math.log(1 + fuzzy), math.log(1 + n) / 5]
    return 1 / (1 + math.exp(-(model.coef[0] + sum(a * b for a, b in zip(model.coef[1:], f, strict=True)))))


def test_scores_equal_brute_force(spark):
    docs, labels = made(spark)
    model = tx.learn(docs, labels)
    assert len(model.terms) > len(tx.SEED) and model.stems
    r = random.Random(4)
    words = [*model.terms, *(t + "z" for t in model.terms), *(t[1:] for t in model.terms), "wort1", "wort2", "you", "said", "“", "”", "flarpzz"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in tx.score_toxicity(rows, model, keep=("doc_id",)).collect():
        assert x["score"] == pytest.approx(plain_score(model, texts[x["doc_id"]]), rel=1e-9)


def test_repeated_ids_count_once_and_score_may_not_clash(spark):
    docs, labels = made(spark)
    again = docs.unionByName(docs).unionByName(docs.where("doc_id = 0"))
    a, b = tx.learn(docs, labels), tx.learn(again, labels.unionByName(labels))
    assert a.terms == b.terms and a.stems == b.stems and a.known == b.known and a.coef == pytest.approx(b.coef, rel=1e-9)
    with pytest.raises(ValueError, match="score"):
        tx.score_toxicity(docs, a, keep=("doc_id", "score"))


def test_short_items_are_never_missed():
    r = random.Random(7)
    seen = dc._Hashes()
    for k in range(2000):
        item = " ".join(f"i{k}x{j}" for j in range(5 + k % 4 * (k % 3 == 0)))
        text = " ".join([f"a{r.randrange(9999)}" for _ in range(30)] + [item] + [f"b{r.randrange(9999)}" for _ in range(30)])
        index = dc.Index.of([(k, item)])
        assert [h[0] for h in index.hits(text, seen)] == [k]
        assert not index.hits(text.replace(f"i{k}x4", "other"), seen)
